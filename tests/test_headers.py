import pytest

from revlens.sources import headers


def _git(spark, *texts, **options):
    raw = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, id string, header string")
    return [(r.author, r.date, r.message) for r in headers.parse_git_headers(raw, **options).orderBy("id").collect()]


def test_git_headers(spark):
    root = "h0\ntree t\nauthor Ann B <a@x> 1000 +0000\ncommitter Cid <c@x> 2000 +0530\n\n    First\n    \n    body\n"
    child = "h1\ntree t\nparent h0\nauthor Odd <one> Name <o@x> 1000 +0000\ncommitter Cid <c@x> 20000 -0330\n\n    Only\n"
    bare = "h2\ntree t\nauthor nomail 1000 +0000\ncommitter c <c@x> 5 +0000\n\n"
    got = _git(spark, root, child, bare)
    assert got[0] == ("Ann B", 2000 + 19800, "First\n\nbody\n")
    assert got[1] == ("Odd <one> Name", 20000 - 12600, "Only\n")
    assert got[2] == ("nomail 1000 +0000", 5, "")
    assert _git(spark, root, local_time=False)[0][1] == 2000


def test_git_header_without_committer(spark):
    with pytest.raises(Exception, match="unable to parse"):
        _git(spark, "h\ntree t\nauthor A <a> 1 +0000\nencoding x\n\n    m\n", strict=True)


def test_bad_headers_do_not_stop_the_others(spark):
    good = "h\ntree t\nauthor A <a> 1 +0000\ncommitter C <c> 7 +0000\n\n    m\n\0   nul\n"
    texts = [good, "h\ntree t\nauthor A <a> 1 +0000\ncommitter C <c> then\n", "h\ntree t\n", "", good]
    assert _git(spark, *texts) == [("A", 7, "m\nnul")] * 2
    raw = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, id string, header string")
    found = {r.id: r.reason for r in headers.rejected_git(raw).collect()}
    assert found == {"1": "bad commit date: committer C <c> then", "2": "no author line", "3": "no author line"}
    props = spark.createDataFrame([("r", "0", {"svn:date": "2011-03-01T21:29:23Z"}), ("r", "1", {"svn:date": "soon"}), ("r", "2", {})], "repo string, id string, props map<string,string>")
    assert sorted((r.id, r.date) for r in headers.parse_svn_props(props).collect()) == [("0", 1299014963), ("2", 0)]
    assert [tuple(r) for r in headers.rejected_svn(props).collect()] == [("r", "1", "bad date: soon")]
    with pytest.raises(Exception, match="unable to parse"):
        headers.parse_svn_props(props, strict=True).collect()


def test_hg_log(spark):
    raw = spark.createDataFrame(
        [("r", "0", "1000 -7200\nann\nfirst\nsecond"), ("r", "1", "1000 3600\nbob"), ("r", "2", "")], "repo string, id string, header string"
    )
    rows = [(r.author, r.date, r.message) for r in headers.parse_hg_log(raw).orderBy("id").collect()]
    assert rows == [("ann", 8200, "first\nsecond"), ("bob", -2600, ""), ("", 0, "")]


def test_svn_props(spark):
    full = {"svn:author": "ann", "svn:date": "2011-03-01T21:29:23.123456Z", "svn:log": "Layout"}
    rows = [("r", str(i), {k: v for k, v in full.items() if k != drop}) for i, drop in enumerate(["", *full])]
    raw = spark.createDataFrame(rows, "repo string, id string, props map<string,string>")
    got = [(r.author, r.date, r.message) for r in headers.parse_svn_props(raw).orderBy("id").collect()]
    assert got == [("ann", 1299014963, "Layout"), ("", 1299014963, "Layout"), ("ann", 0, "Layout"), ("ann", 1299014963, "")]
