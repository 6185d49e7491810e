"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ORDERS_AS_OF, day, label_sql, registry, r6, slot_sql, sql
from revlens.model import LINE, REV, STAT_COLUMNS
from revlens.operators import ranking, series, sets, totals
from revlens.plans import params, reports
from revlens.sources import adapters, tables

ENTRIES, check = registry()


@check(
    sql(
        "fc",
        """SELECT rev.repo, branch, id, seq, coalesce(path, '') AS path, coalesce(bytes_added, 0) AS bytes_added, coalesce(lines_added, 0) AS lines_added,
  coalesce(bytes_removed, 0) AS bytes_removed, coalesce(lines_removed, 0) AS lines_removed FROM rev LEFT JOIN fc USING (repo, id)""",
    )
)
def jon1_revision_changes(spark, folder):
    log = adapters.orders_log(spark, folder)
    rows = totals.revision_changes(log.revisions, log.file_changes)
    return rows.select(*LINE, "id", "seq", F.coalesce("path", F.lit("")).alias("path"), *STAT_COLUMNS)


@check(sql("tags", "SELECT tags.repo, name, date FROM tags JOIN rev USING (repo, id)"))
def jon2_tag_marks(spark, folder):
    return reports.tag_marks(adapters.orders_log(spark, folder))


@check(sql("br", "SELECT br.repo, br.branch, id, date, author, is_default FROM br JOIN rev ON rev.repo = br.repo AND rev.branch = br.branch AND id = head_id"))
def jon3_branch_heads(spark, folder):
    heads = tables.branch_heads(adapters.orders_log(spark, folder))
    return heads.select(*LINE, "id", "date", "author", "is_default")


_BUSIEST = """WITH a AS (SELECT repo, branch, author, count(*) AS commits FROM rev GROUP BY 1, 2, 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY commits DESC, author) AS k FROM a) WHERE k <= 6)"""


def _busiest(revs):
    return ranking.rank(totals.commits_by_author(revs), LINE, "commits", ["author"], 6)


@check(sql("rev", f"{_BUSIEST} SELECT repo, branch, id, author FROM rev SEMI JOIN top USING (repo, branch, author)"))
def jon4_keep_top(spark, folder):
    revs = adapters.order_revisions(spark, folder)
    return ranking.keep_members(revs, _busiest(revs), LINE + ["author"]).select(*LINE, "id", "author")


@check(
    sql(
        "rev",
        f"""{_BUSIEST} SELECT repo, branch, CASE WHEN k IS NULL THEN 'Others' ELSE author END AS author, CAST(sum(a.commits) AS BIGINT) AS n
FROM a LEFT JOIN (SELECT repo, branch, author, k FROM top) t USING (repo, branch, author) GROUP BY 1, 2, 3""",
    )
)
def jon5_label_others(spark, folder):
    counts = totals.commits_by_author(adapters.order_revisions(spark, folder))
    top = ranking.rank(counts, LINE, "commits", ["author"], 6)
    named = ranking.label_others(counts, top, LINE + ["author"], "author")
    return named.groupBy(*LINE, "author").agg(F.sum("commits").alias("n"))


SLOTS = "all,3y,12m,10w,m"
SLOT_TABLE = """slot AS (SELECT * FROM (VALUES ('All Time', CAST(-1 AS BIGINT)), ('Past 3 years', 915148800), ('Past 12 months', 967766400),
  ('Past 10 weeks', 990921600), ('This month', 996624000)) v(slot, first))"""


@check(sql("rev", f"WITH {SLOT_TABLE} SELECT repo, branch, slot, count(*) AS n FROM rev JOIN slot ON date >= first GROUP BY 1, 2, 3"))
def jon6_slots(spark, folder):
    revs = adapters.order_revisions(spark, folder)
    members = totals.in_slots(revs, params.volume_slots(ORDERS_AS_OF, SLOTS))
    return members.groupBy(*LINE, "slot").agg(F.count("*").alias("n"))


@check(
    sql(
        "tot",
        f"""WITH spine AS (SELECT repo, branch, CAST(s AS DATE) AS d
  FROM (SELECT DISTINCT repo, branch FROM rev), generate_series(DATE '1994-01-02', DATE '2001-07-29', INTERVAL 7 DAY) g(s)),
cnt AS (SELECT repo, branch, {slot_sql(day('date'), 'weeks')} AS slot, count(*) AS commits, CAST(sum(files) AS BIGINT) AS changes FROM tot GROUP BY 1, 2, 3)
SELECT repo, branch, CAST(epoch(d) AS BIGINT) AS slot, {label_sql('d', 'weeks')} AS label, coalesce(commits, 0) AS commits, coalesce(changes, 0) AS changes
FROM (SELECT *, CAST(epoch(d) AS BIGINT) AS slot FROM spine) LEFT JOIN cnt USING (repo, branch, slot)""",
    )
)
def jon7_calendar_spine(spark, folder):
    # 396 weeks back from the week of the reference moment is Sunday 1994-01-02
    return reports.commit_counts(adapters.orders_log(spark, folder), ORDERS_AS_OF, "396weeks", "weeks")


SMOOTH_BODY = """, grid AS (SELECT CAST(i AS INTEGER) AS i FROM generate_series(0, 1000) g(i)),
ext AS (SELECT repo, branch, min(date) AS lo, max(date) - min(date) AS span FROM s GROUP BY 1, 2),
daily AS (SELECT repo, branch, series, date, sum(n) AS n FROM s GROUP BY 1, 2, 3, 4),
keyed AS (SELECT DISTINCT repo, branch, series FROM daily),
hit AS (
  SELECT d.repo, d.branch, d.series, i, sum(n * (25 * span - ((date - lo) * 1000 - span * (i + 1)))) AS v
  FROM daily d JOIN ext e ON d.repo = e.repo AND d.branch = e.branch
  JOIN grid ON (date - lo) * 1000 >= span * (i + 1 - 25) AND (date - lo) * 1000 < span * (i + 1 + 25)
  GROUP BY 1, 2, 3, 4)
SELECT k.repo, k.branch, k.series, grid.i AS point, round(lo + span * (grid.i + 1) / 1000.0, 6) AS x,
  round(CAST(coalesce(v, 0) AS DOUBLE) / (25.0 * span), 6) AS y
FROM keyed k JOIN ext e ON k.repo = e.repo AND k.branch = e.branch CROSS JOIN grid
LEFT JOIN hit ON hit.repo = k.repo AND hit.branch = k.branch AND hit.series = k.series AND hit.i = grid.i"""


@check(sql("ev", "WITH s AS (SELECT repo, branch, 'all' AS series, date, 1 AS n FROM ev WHERE date <> 0)" + SMOOTH_BODY))
def jon8_window_join(spark, folder):
    curve = reports.activity(adapters.events_log(spark, folder))
    return curve.select(*LINE, "series", "point", r6("x").alias("x"), r6("y").alias("y"))


@check(
    sql(
        "tot",
        """WITH a AS (SELECT repo, branch, author, sum(lines_added) AS loc FROM tot GROUP BY 1, 2, 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY loc DESC, author) AS k FROM a) WHERE k <= 4)
SELECT t.repo, t.branch, t.date, t.seq, top.author,
  CAST(sum(CASE WHEN t.author = top.author THEN lines_added ELSE 0 END) OVER (PARTITION BY t.repo, t.branch, top.author ORDER BY date, seq) AS BIGINT) AS loc
FROM tot t JOIN top ON t.repo = top.repo AND t.branch = top.branch""",
    )
)
def jon9_dense_grid(spark, folder):
    return reports.authors(adapters.orders_log(spark, folder), n=4)


@check(sql("fc", "SELECT repo, id FROM rev ANTI JOIN fc USING (repo, id)"))
def jon10_not_stored(spark, folder):
    log = adapters.orders_log(spark, folder)
    return sets.missing_ids(log.revisions.select(*REV), log.file_changes)


@check(sql("rev", "SELECT repo, branch, id, coalesce(lag(id) OVER (PARTITION BY repo, branch ORDER BY seq), '') AS parent_id FROM rev"))
def jon11_parent_pairs(spark, folder):
    paired = series.with_parent(adapters.order_revisions(spark, folder))
    return paired.select(*LINE, "id", F.coalesce("parent_id", F.lit("")).alias("parent_id"))


@check(sql("fc ev", "SELECT repo, id FROM rev UNION SELECT repo, id FROM fc UNION SELECT repo, id FROM ev"))
def set1_union_ids(spark, folder):
    log = adapters.orders_log(spark, folder)
    fetched = log.revisions.select(*REV).unionByName(adapters.events_log(spark, folder).revisions.select(*REV))
    return sets.union_ids(fetched, log.file_changes)


@check(sql("rev tags", "SELECT repo, id FROM rev EXCEPT SELECT repo, id FROM tags"))
def set2_missing_ids(spark, folder):
    log = adapters.orders_log(spark, folder)
    return sets.missing_ids(log.revisions.select(*REV), log.tags)


@check(sql("rev tags", "SELECT repo, id FROM rev INTERSECT SELECT repo, id FROM tags"))
def set3_hit_ids(spark, folder):
    log = adapters.orders_log(spark, folder)
    return sets.hit_ids(log.revisions.select(*REV), log.tags)


@check(
    sql(
        "rev fc",
        """SELECT repo, path, id, bytes_added, lines_added, bytes_removed, lines_removed FROM (
  SELECT rev.repo, path, id, bytes_added, lines_added, bytes_removed, lines_removed,
    row_number() OVER (PARTITION BY rev.repo, path ORDER BY seq DESC) AS k FROM fc JOIN rev USING (repo, id)) WHERE k = 1""",
    )
)
def set4_overlay(spark, folder):
    log = adapters.orders_log(spark, folder)
    rows = log.file_changes.join(log.revisions.select(*REV, "seq"), REV)
    return sets.overlay(rows, ["repo", "path"], "seq").drop("seq")
