"""Log files read by byte ranges give what the row-wise parsers give."""

import random

import pytest

from revlens.sources import headers, rawlogs
from revlens.streaming import feeds


def git_records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = "".join(f"    {'ä line of text ' * rng.randint(0, 9)}{k}\n" for k in range(rng.randint(0, 5)))
        out.append((f"c{i:07}", f"c{i:07}\ntree t\nparent p{i}\nauthor A{i % 7} <a@x> 1 +0000\ncommitter C <c@x> {1000 + i} {rng.choice(['+0000', '+0530', '-0330'])}\n\n{body}"))
    return out


@pytest.fixture(scope="module")
def log_file(tmp_path_factory):
    own = git_records(8000)
    path = tmp_path_factory.mktemp("raw") / "log.bin"
    path.write_bytes(b"".join(header.encode() + b"\0" for _, header in own))
    return str(path), own


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_file_is_read_by_many_tasks(spark, log_file):
    path, own = log_file
    raw = spark.createDataFrame([("r", i, h) for i, h in own], "repo string, id string, header string")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        got = rawlogs.git_log(spark, path, "r")
        assert got.rdd.getNumPartitions() > 10
        assert rows(got) == rows(headers.parse_git_headers(raw)) and got.count() == 8000
        assert rows(rawlogs.raw_headers(spark, path, "r")) == rows(raw)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_bad_records_are_listed(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"c1\ntree t\nauthor A <a> 1 +0000\ncommitter C <c> 7 +0000\n\n    m\n\0c2\ntree t\n\0\0c3")
    assert [r.id for r in rawlogs.git_log(spark, str(path), "r").collect()] == ["c1"]
    assert sorted(r.id for r in headers.rejected_git(rawlogs.raw_headers(spark, str(path), "r")).collect()) == ["c2", "c3"]
    with pytest.raises(Exception, match="unable to parse"):
        rawlogs.git_log(spark, str(path), "r", strict=True).collect()


def test_hg_log_with_another_mark(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes("h1\n1000 -3600\nAnn\nFirst\nline--end--\nh2\n5 0\nBob\n--end--\n".encode())
    assert rows(rawlogs.hg_log(spark, str(path), "r", end="--end--\n")) == [("r", "h1", "Ann", 4600, "First\nline"), ("r", "h2", "Bob", 5, "")]


def test_files_that_are_added_are_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    own = git_records(60, 2)
    for k in range(3):
        (folder / f"log{k}").write_bytes(b"".join(h.encode() + b"\0" for _, h in own[k * 20 : k * 20 + 20]))
        got = feeds.append_to(rawlogs.git_log(spark, str(folder), "r", stream=True), str(tmp_path / "out"))
        assert got.count() == k * 20 + 20
    raw = spark.createDataFrame([("r", i, h) for i, h in own], "repo string, id string, header string")
    assert rows(got) == rows(headers.parse_git_headers(raw))
