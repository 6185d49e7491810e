import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.model import SCHEMAS, ChangeLog  # noqa: E402
from revlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column_of(spark):
    """Evaluate a column function over (in..., out) rows and return what differs."""

    def run(fn, rows, schema):
        from pyspark.sql import functions as F

        names = [part.split()[0] for part in schema.split(", ")]
        df = spark.createDataFrame(rows, schema)
        got = df.withColumn("got", fn(*[F.col(n) for n in names[:-1]])).collect()
        return [tuple(r) for r in got if r["got"] != r[names[-1]]]

    return run


@pytest.fixture(scope="session")
def make_log(spark):
    """ChangeLog from lists of row dicts."""

    def build(**tables):
        frames = {}
        for name, rows in tables.items():
            schema = SCHEMAS[name]
            frames[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
        return ChangeLog(**frames)

    return build


@pytest.fixture(scope="session")
def history(make_log):
    """A small two-branch history with every kind of gap the reports care about."""

    def rev(seq, date, author, message, branch="main", repo="tools/demo"):
        return dict(repo=repo, branch=branch, id=f"r{seq}", seq=seq, date=date, author=author, message=message)

    def change(seq, path, la, lr, repo="tools/demo"):
        return dict(repo=repo, id=f"r{seq}", path=path, lines_added=la, lines_removed=lr, bytes_added=la * 10, bytes_removed=lr * 10)

    day = 86400
    start = 1299014963
    return make_log(
        revisions=[
            rev(1, start, "ann", "Layout"),
            rev(2, start + day, "ann", "Second\nline\n\nbody"),
            rev(3, start + 2 * day, "bob", "Third\nmore"),
            rev(4, start + 3 * day, "bob", "Fourth, \"quoted\""),
            rev(5, 0, "bob", "Undated"),
            rev(6, start + 4 * day, "", "Anonymous"),
            rev(7, start + 4 * day, "cid", "Tie on date"),
            rev(8, start + 5 * day, "cid", "Side", branch="side"),
        ],
        file_changes=[
            change(1, "src/a.c", 10, 0),
            change(1, "README", 4, 0),
            change(2, "src/a.c", 3, 1),
            change(3, "src/b.c", 7, 0),
            change(4, "src/a.c", 0, 12),
            change(5, "doc/x.txt", 2, 0),
            change(6, "doc/y.txt", 5, 0),
            change(7, "README", 1, 4),
            change(8, "side.py", 9, 0),
        ],
        tags=[dict(repo="tools/demo", name="v1", id="r2"), dict(repo="tools/demo", name="rc-1", id="r4")],
        branches=[
            dict(repo="tools/demo", branch="main", head_id="r7", is_default=True),
            dict(repo="tools/demo", branch="side", head_id="r8", is_default=False),
        ],
        tree=[dict(repo="tools/demo", id="r7", path=p) for p in ("src/a.c", "src/b.c", "README", "doc/x.txt", "Makefile.am", ".hidden")]
        + [dict(repo="tools/demo", id="r1", path="src/a.c")],
    )
