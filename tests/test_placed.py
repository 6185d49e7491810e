"""A change log stored by month and bucket: same answers, fewer files."""

import pytest

from revlens.operators import select as sel
from revlens.operators import totals
from revlens.plans import reports
from revlens.sources import tables

DAY = 86400
START = 1299014963


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """A log of three years as it is, and stored by month and bucket; some changes lack a revision, some revisions a date."""
    from revlens.model import SCHEMAS, ChangeLog

    revs = [("r", f"b{i % 2}", f"c{i}", None, f"a{i % 7}", f"m{i}", i, 0 if i % 50 == 0 else START + i * DAY) for i in range(1000)]
    names = [f.name for f in SCHEMAS["revisions"]]
    order = ["repo", "branch", "id", "parent_id", "author", "message", "seq", "date"]
    assert sorted(names) == sorted(order)
    changes = [("r", f"c{i}", f"d{i % 3}/f{k}", 10, 1 + k, 5, k) for i in range(1005) if i % 9 for k in range(i % 4 + 1)]
    log = ChangeLog(spark.createDataFrame(revs, ", ".join(f"{n} {'long' if n in ('seq', 'date') else 'string'}" for n in order)).select(*names), spark.createDataFrame(changes, SCHEMAS["file_changes"]))
    path = str(tmp_path_factory.mktemp("placed") / "log")
    tables.save_changelog(log, path, buckets=4)
    return log, tables.load_changelog(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_same_tables(logs):
    plain, placed = logs
    assert placed.file_changes.columns == plain.file_changes.columns and rows(placed.file_changes) == rows(plain.file_changes)


@pytest.mark.parametrize(
    "report",
    [
        lambda log: reports.activity(log, "files", datemin="2012-01-01", datemax="2012-03-01"),
        lambda log: reports.activity(log, "authors", changes=True, datemin="2012-01-01"),
        lambda log: reports.commit_counts(log, START + 1000 * DAY, "3months"),
        lambda log: reports.participation(log, "a1", START + 1000 * DAY, "2months", changes=True),
        lambda log: reports.volume(log, START + 1000 * DAY, "12m,m", changes=True),
        lambda log: reports.volume(log, START + 1000 * DAY, "all,m", changes=True, branch="b1"),
        lambda log: reports.directories(log, branch="b0", datemax="2011-06-01"),
        lambda log: reports.diffstat(log, id="c77"),
        lambda log: reports.diffstat(log, branch="b1"),
        lambda log: reports.csv(log, "id,files,total", datemin="2012-01-01", datemax="2012-02-01"),
        lambda log: reports.revdump(log, id="c77"),
        lambda log: totals.selected_totals(log, sel.revisions(log, stop=0)),
        lambda log: totals.selected_totals(log, sel.revisions(log, start=START * 2)),
    ],
)
def test_same_reports(logs, report):
    plain, placed = logs
    assert rows(report(plain)) == rows(report(placed))


def test_volume_with_all_time_ignores_no_revision(logs):
    plain, _ = logs
    recent = rows(reports.volume(plain, START + 1000 * DAY, "12m,m", changes=True))
    whole = rows(reports.volume(plain, START + 1000 * DAY, "12m,m", changes=False))
    assert {r[:3] for r in recent} == {r[:3] for r in whole}


def files_read(spark, df, column):
    """Files that the scan with this column has opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        leaves = [leaves.apply(i) for i in range(leaves.size())]
        return sum(x.metrics().apply("numFiles").value() for x in leaves if column in x.simpleString(1000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_files_read_shrink_with_the_period(spark, logs):
    _, log = logs
    whole = files_read(spark, log.file_changes, "path#")
    month = totals.changes_of(log, sel.revisions(log, start=START + 300 * DAY, stop=START + 320 * DAY))
    one = totals.changes_of(log, sel.revision(log, "c77"))
    assert whole > 100 and 1 <= files_read(spark, month, "path#") <= 12 and files_read(spark, one, "path#") == 1
