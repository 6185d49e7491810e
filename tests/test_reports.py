"""Reports on a small hand-made history."""

import json

import pytest
from pyspark.sql import functions as F

from revlens.operators import select as sel
from revlens.operators import series, totals
from revlens.operators.select import DEFAULT_BRANCH
from revlens.plans import reports
from revlens.plans.params import parse_date
from revlens.sinks import dumps
from revlens.sources import tables

DAY = 86400
START = 1299014963  # 2011-03-01 21:29:23, a Tuesday
AS_OF = parse_date("2011-03-20")


def test_selection(history):
    assert [r.id for r in sel.revisions(history, "main", START + 2 * DAY, START + 3 * DAY, in_order=True).collect()] == ["r3", "r4"]
    assert sel.revisions(history, DEFAULT_BRANCH).count() == 7
    assert [r.id for r in sel.revision(history, "r8").collect()] == ["r8"]
    assert sel.filter_prefix(history.file_changes, "src/").count() == 4
    assert sorted(r.name for r in sel.filter_tags(history.tags, "rc").collect()) == ["rc-1"]
    assert sel.filter_tags(history.tags).count() == 2


def test_parents_follow_the_branch(history):
    parents = {r.id: r.parent_id for r in series.with_parent(history.revisions).collect()}
    assert parents["r1"] is None and parents["r8"] is None and parents["r7"] == "r6"


def test_loc(history):
    got = [(r.date, r["loc"]) for r in reports.loc(history, branch="main").orderBy("date").collect()]
    assert got == [(START, 14), (START + DAY, 16), (START + 2 * DAY, 23), (START + 3 * DAY, 11), (START + 4 * DAY, 13)]
    late = [(r.date, r["loc"]) for r in reports.loc(history, branch="main", datemin="2011-03-04").orderBy("date").collect()]
    assert late == got[3:]
    early = reports.loc(history, branch="main", datemax="2011-03-03").orderBy("date").collect()
    assert [(r.date, r["loc"]) for r in early] == got[:2]


def test_authors(history):
    rows = reports.authors(history, n=1, branch="main").orderBy("date", "seq").collect()
    assert {r.author for r in rows} == {"ann"}
    assert [(r.seq, r["loc"]) for r in rows] == [(5, 0), (1, 14), (2, 17), (3, 17), (4, 17), (7, 17)]


def test_authors_pie(history):
    commits = {r.author: r.share for r in reports.authors_pie(history, branch="main").collect()}
    assert commits == {"bob": 0.5, "ann": 2 / 6, "cid": 1 / 6}
    lines = {r.author: r.share for r in reports.authors_pie(history, n=1, changes=True, branch="main", datemin="2011-03-20").collect()}
    assert lines == {"ann": 17 / 27, "Others": 10 / 27}


def test_directories(history):
    rows = reports.directories(history, n=2, branch="main").where("seq = 7").collect()
    assert {r.directory: r["loc"] for r in rows} == {"src": 7, "doc": 7}
    every = reports.directories(history, n=6, branch="main").where("seq = 7").collect()
    assert {r.directory: r["loc"] for r in every} == {"src": 7, "doc": 7, "/": 1}


def test_commit_counts(history):
    rows = reports.commit_counts(history, AS_OF, "3weeks", "weeks", branch="main").orderBy("slot").collect()
    # as_of is the midnight that starts a Sunday: its own week has not begun
    assert [(r.slot, r.commits, r.changes) for r in rows] == [(parse_date("2011-03-06"), 0, 0), (parse_date("2011-03-13"), 0, 0)]
    days = reports.commit_counts(history, AS_OF, "20d", "days", branch="main")
    assert days.count() == 19 and days.agg(F.sum("commits")).first()[0] == 6


def test_participation(history):
    row = reports.participation(history, "ann", AS_OF, "1y", "years", branch="main").collect()
    assert [(r.label, r.own, r.others) for r in row] == [("2011", 2, 4)]
    lines = reports.participation(history, "ann", AS_OF, "1y", "years", changes=True, branch="main").collect()
    assert [(r.own, r.others) for r in lines] == [(17, 13)]


def test_volume(history):
    rows = reports.volume(history, AS_OF, "all,17d,d", n=2, branch="main").collect()
    got = {(r.slot, r.author): r.pct for r in rows}
    assert got["All Time", "bob"] == 100 * 3 / 7
    assert got["Today", "Others"] == 100.0 and got["Today", "bob"] == 0.0
    for slot in ("All Time", "Past 17 days", "Today"):
        assert abs(sum(v for (s, _), v in got.items() if s == slot) - 100) < 1e-9


def test_punchcard_and_times(history):
    cells = {(r.dow, r.hour): (r.n, r.size) for r in reports.punchcard(history, branch="main").collect()}
    assert cells[6, 21] == (2, 0.5) and cells[2, 21] == (1, 0.25)
    assert sum(n for n, _ in cells.values()) == 6
    own = reports.punchcard(history, author="cid", branch="main").collect()
    assert [(r.dow, r.hour, r.n) for r in own] == [(6, 21, 1)]
    hours = {r.hour_of_day for r in reports.commit_times(history).collect()}
    assert hours == {21 + 29 / 60}


def test_filetypes(history):
    rows = {r.language: (r.n, r["rank"]) for r in reports.filetypes(history).collect()}
    # README and .hidden have no extension: second by count, but trading places with the last
    assert rows == {"C/C++": (2, 1), "Text": (1, 2), "Autotools": (1, 3), "unknown": (2, 4)}
    pie = {r.language: (r["rank"], r.share) for r in reports.filetypes(history, n=2, pie=True).collect()}
    assert pie == {"C/C++": (1, 2 / 6), "unknown": (2, 2 / 6), "Other": (3, 2 / 6)}
    assert [r.language for r in reports.filetypes(history, id="r1").collect()] == ["C/C++"]


def test_shortlog(history):
    lines = reports.shortlog(history, branch="main").collect()
    assert [(r.author, r.n, r.line) for r in lines] == [
        ("ann", 2, "      Layout"), ("ann", 2, "      Second    line"), ("bob", 3, "      Third"), ("bob", 3, '      Fourth, "quoted"'),
        ("bob", 3, "      Undated"), ("cid", 1, "      Tie on date"),
    ]
    summary = reports.shortlog(history, summary=True, numbered=True, branch="main").collect()
    assert [r.line for r in summary] == ["     3\tbob", "     2\tann", "     1\tcid"]


def test_directories_deal_commits_before_their_sums(history, monkeypatch):
    """The n sums of a commit are formed after its narrow rows were dealt, never by a task for all the rows it reads."""
    frame = type(history.revisions)
    dealt, parts = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *to: dealt.append((df.columns, to)) or parts(df, *to))
    found = reports.directories(history, n=2)
    assert [to[1:] for columns, to in dealt if not any(c.startswith("__v") or c == "names" for c in columns)] == [("repo", "branch", "date", "seq")]
    commits = history.revisions.select("repo", "branch", "date", "seq").distinct().count()
    assert found.select("repo", "branch", "date", "seq").distinct().count() <= commits


def test_diffstat(history):
    rows = reports.diffstat(history, id="r1").orderBy("part", "path").collect()
    assert [r.line for r in rows] == [
        " README  |    4 ++++", " src/a.c |   10 ++++++++++", " 2 files changed, 14 insertions(+), 0 deletions(-)",
    ]


def test_diffstat_of_long_names(make_log):
    path = "deep/" * 14 + "file.c"
    log = make_log(
        revisions=[dict(repo="x", branch="b", id="1", seq=1, date=1, author="a", message="m")],
        file_changes=[dict(repo="x", id="1", path=path, lines_added=300, lines_removed=100, bytes_added=1, bytes_removed=1)],
    )
    line = reports.diffstat(log).where("part = 0").first().line
    name, _, bar = line[1:].partition(" | ")
    assert name.startswith(".../") and len(name) == 55
    assert bar == " 400 " + "+" * 11 + "-" * 4


def test_dumps(history):
    rows = reports.csv(history, "id,a,+,-,d,t,f,m", branch="main").orderBy("seq").collect()
    assert rows[0].line == f"{START},r1,ann,14,0,14,14,README:src/a.c,\"Layout\""
    assert rows[3].line == f'{START + 3 * DAY},r4,bob,0,12,-12,11,src/a.c,"Fourth\\, \\"quoted\\""'
    clipped = reports.csv(history, "t", branch="main", datemin="2011-03-04").orderBy("seq").collect()
    assert clipped[0].line == f"{START + 3 * DAY},11"
    current = reports.data(history, "csv", "a,f,m", branch="main").orderBy("seq").collect()
    assert current[3].line == f'{START + 3 * DAY},"bob","src/a.c","Fourth\\, \\"quoted\\""'
    parsed = [json.loads(r.line) for r in reports.data(history, "json", "id,f,m,t").orderBy("seq").collect()]
    assert parsed[1] == [START + DAY, "r2", ["src/a.c"], "Second\nline\n\nbody", 16]
    with pytest.raises(ValueError):
        reports.data(history, "xml")


def test_json_of_an_empty_file_list(make_log):
    log = make_log(revisions=[dict(repo="x", branch="b", id="1", seq=1, date=9, author="a", message="m")], file_changes=[])
    assert [r.line for r in reports.data(log, "json", "f,a").collect()] == ['[9,[],"a"]']


def test_dump_files(history, tmp_path, spark):
    path = str(tmp_path / "dump")
    dumps.write_dump(reports.csv(history, branch="main"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "# Timestamp, Author, Line delta, Total lines" and lines[1] == f"{START},ann,14,14"
    assert len(lines) == 8


def test_revdump(history):
    lines = [r.line for r in reports.revdump(history, id="r2").orderBy("seq", "section", "path").collect()]
    head = ["-- Revision", "r2", "-- Date", str(START + DAY), "-- Author", "ann", "-- Message ", "Second\nline\n\nbody", "-- Diffstat"]
    assert "\n".join(lines) == "\n".join(head + ["src/a.c +3 -1 +30 -10", "=" * 66])


def test_lists(history):
    assert [r.line for r in reports.branch_list(history).collect()] == ["* main r7", "  side r8"]
    assert [r.line for r in reports.tag_list(history).collect()] == ["rc-1  r4", "v1    r2"]
    assert [r.branch for r in reports.branch_order(history.branches).collect()] == ["main", "side"]
    assert {(r.name, r.date) for r in reports.tag_marks(history, "^v").collect()} == {("v1", START + DAY)}
    assert {r.id for r in tables.branch_heads(history).collect()} == {"r7", "r8"}
    assert {r.branch: r.head_id for r in tables.heads(history).collect()} == {"main": "r7", "side": "r8"}


def test_age(history):
    def lines(as_of):
        row = reports.age(history, as_of).first()
        return row.age, row.next_birthday

    assert lines(AS_OF) == ("demo is 18 days old", "demo's birthday is in 11 months (March 1st)")
    assert lines(parse_date("2013-03-01")) == ("demo is 2 years old", "Happy birthday, demo!")
    assert lines(parse_date("2012-03-01")) == ("demo is 1 year old", "Happy birthday, demo!")
    assert lines(START + 5) == ("", "Happy birthday, demo!")
    assert lines(START - 5) == ("demo is not born yet!", "")


def test_activity(history):
    none = reports.activity(history, branch="main")
    assert none.count() == 1001
    split = reports.activity(history, "files", changes=True, n=2, branch="main")
    # README was touched on two dates and src/a.c on three
    assert {r.series for r in split.select("series").distinct().collect()} == {"src/a.c", "README"}
    with pytest.raises(ValueError):
        reports.activity(history, "branches")


def test_cat(make_log, spark):
    log = make_log(
        revisions=[],
        contents=[dict(repo="x", path="f", id=f"v{s}", seq=s, content=f"text {s}") for s in (1, 4, 9)]
        + [dict(repo="x", path="g", id="v5", seq=5, content="g")],
    )
    asked = spark.createDataFrame([("x", "f", 0), ("x", "f", 4), ("x", "f", 8), ("x", "f", None), ("x", "g", 100)], "repo string, path string, seq bigint")
    got = {(r.path, r.seq): r.content for r in tables.cat(log, asked).collect()}
    assert got == {("f", 4): "text 4", ("f", 8): "text 4", ("f", None): "text 9", ("g", 100): "g"}


def test_tree_from_changes(history):
    alive = {r.path for r in tables.tree_from_changes(history, "main", 3).collect()}
    assert alive == {"src/a.c", "README", "src/b.c"}
    assert "src/a.c" not in {r.path for r in tables.tree_from_changes(history, "main", 4).collect()}
    assert {r.path: r.lines for r in tables.tree_from_changes(history, "main").collect()}["README"] == 1


def test_save_and_load(history, spark, tmp_path):
    path = str(tmp_path / "log")
    tables.save_changelog(history, path)
    again = tables.load_changelog(spark, path)
    assert again.contents is None
    assert sorted(map(tuple, again.file_changes.collect())) == sorted(map(tuple, history.file_changes.collect()))
    with pytest.raises(ValueError):
        again.need("contents")
    assert reports.loc(again).count() == reports.loc(history).count()


def test_churn_and_layout(history):
    rows = totals.revision_totals(history.revisions, history.file_changes)
    assert {r.author: r.churn for r in totals.churn(rows, ["author"]).collect()}["bob"] == 21
    stats = {r.id: (r.max_len, r.max_change) for r in totals.layout_stats(history.file_changes).collect()}
    assert stats["r1"] == (7, 10)


def test_tags_on_time_series(history):
    marks = {r.tags: r.date for r in reports.loc(history, branch="main", tags="^v").collect() if r.tags}
    assert list(marks) == ["v1"]
    for report in (reports.authors, reports.directories):
        assert {r.tags for r in report(history, branch="main", tags=".").collect()} == {None, "v1", "rc-1"}
    curves = reports.activity(history, "a", branch="main", tags="^v").collect()
    assert [(r.series, r.x) for r in curves if r.point is None] == [("v1", float(marks["v1"]))]
    assert {r.series for r in reports.activity(history, "authors", branch="main").collect()} == {r.series for r in curves} - {"v1"}


def test_intermediates_are_deleted_with_their_owner(history, spark):
    import os

    from revlens.session import shared_dir, temporary

    before = set(os.listdir(shared_dir(spark)))
    with temporary(spark):
        assert reports.authors(history).count() > 0
    assert set(os.listdir(shared_dir(spark))) == before
