"""Ordered computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ORDERS_AS_OF, registry, r6, sql
from checks.joins import SMOOTH_BODY
from checks.totals import PIE_SQL, _SHARE
from revlens.model import LINE, REV
from revlens.operators import lineage, ranking, series, totals
from revlens.plans import reports
from revlens.sources import adapters

ENTRIES, check = registry()


def _totals(log):
    return totals.revision_totals(log.revisions, log.file_changes)


LOC_SQL = """SELECT repo, branch, date, CAST(sum(sum(lines_added - lines_removed)) OVER (PARTITION BY repo, branch ORDER BY date) AS BIGINT) AS loc
FROM tot WHERE date <> 0 GROUP BY 1, 2, 3"""


@check(sql("tot", LOC_SQL))
def win1_loc_curve(spark, folder):
    return series.loc_curve(totals.net_by_date(_totals(adapters.orders_log(spark, folder))))


@check(
    sql(
        "tot",
        "SELECT repo, branch, seq, id, CAST(sum(lines_added - lines_removed) OVER (PARTITION BY repo, branch ORDER BY seq) AS BIGINT) AS total FROM tot",
    )
)
def win2_running_total(spark, folder):
    return series.running_total(_totals(adapters.orders_log(spark, folder))).select(*LINE, "seq", "id", "total")


def series_sql(entity, metric, source, shown, n):
    return f"""WITH m AS ({source}),
a AS (SELECT repo, branch, entity, sum(v) AS v FROM m WHERE entity IS NOT NULL GROUP BY 1, 2, 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY v DESC, entity) AS k FROM a) WHERE k <= {n}),
pt AS (SELECT DISTINCT repo, branch, date, seq FROM m),
g AS (SELECT pt.repo, pt.branch, pt.date, pt.seq, top.entity, coalesce(d.v, 0) AS v FROM pt JOIN top ON top.repo = pt.repo AND top.branch = pt.branch
  LEFT JOIN (SELECT repo, branch, seq, entity, sum(v) AS v FROM m GROUP BY 1, 2, 3, 4) d
  ON d.repo = pt.repo AND d.branch = pt.branch AND d.seq = pt.seq AND d.entity = top.entity)
SELECT repo, branch, date, seq, {shown} AS {entity}, CAST(sum(v) OVER (PARTITION BY repo, branch, entity ORDER BY date, seq) AS BIGINT) AS {metric} FROM g"""


AUTHORS_SQL = series_sql("author", "loc", "SELECT repo, branch, date, seq, author AS entity, lines_added AS v FROM tot WHERE author <> ''", "entity", 6)
DIRECTORIES_SQL = series_sql(
    "directory",
    "loc",
    """SELECT repo, branch, date, seq, '/' || regexp_replace(path, '/[^/]*$', '') AS entity, coalesce(lines_added - lines_removed, 0) AS v
  FROM rev LEFT JOIN fc USING (repo, id)""",
    "substr(entity, 2)",
    6,
)


@check(sql("tot", AUTHORS_SQL))
def win3_author_series(spark, folder):
    return reports.authors(adapters.orders_log(spark, folder))


@check(sql("fc", DIRECTORIES_SQL))
def win4_directory_series(spark, folder):
    return reports.directories(adapters.orders_log(spark, folder))


@check(
    sql(
        "fc",
        """WITH a AS (SELECT rev.repo, branch, path, CAST(sum(lines_added) AS BIGINT) AS loc FROM rev JOIN fc USING (repo, id) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo, branch ORDER BY loc DESC, path) AS INTEGER) AS rank FROM a) WHERE rank <= 10""",
    )
)
def win5_rank(spark, folder):
    log = adapters.orders_log(spark, folder)
    touched = log.file_changes.join(log.revisions.select(*LINE, "id"), REV)
    sizes = touched.groupBy(*LINE, "path").agg(F.sum("lines_added").alias("loc"))
    return ranking.rank(sizes, LINE, "loc", ["path"], 10)


@check(sql("rev", "SELECT repo, branch, seq, id, coalesce(lag(id) OVER (PARTITION BY repo, branch ORDER BY seq), '') AS parent_id, date, author FROM rev"))
def win6_parent_id(spark, folder):
    paired = series.with_parent(adapters.order_revisions(spark, folder))
    return paired.select(*LINE, "seq", "id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "date", "author")


@check(
    "WITH RECURSIVE "
    + sql(
        "rev",
        """WITH dag AS (SELECT repo, author AS branch, id, lag(id) OVER (PARTITION BY repo, author ORDER BY date, seq) AS parent_id,
  row_number() OVER (PARTITION BY repo, author ORDER BY date DESC, seq DESC) AS k FROM rev),
walk AS (SELECT repo, branch, id, CAST(0 AS BIGINT) AS depth, parent_id FROM dag WHERE k = 1
  UNION ALL SELECT walk.repo, walk.branch, dag.id, depth + 1, dag.parent_id FROM walk JOIN dag ON dag.repo = walk.repo AND dag.id = walk.parent_id)
SELECT repo, branch, id, depth FROM walk""",
    )[5:]
)
def win7_first_parent(spark, folder):
    return lineage.first_parent_chain(*adapters.order_dag(spark, folder))


@check(
    sql(
        "fc",
        """WITH m AS (SELECT rev.repo, branch, '/' || regexp_replace(path, '/[^/]*$', '') AS series, date, lines_added + lines_removed AS n
  FROM rev JOIN fc USING (repo, id) WHERE date <> 0),
act AS (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY dates DESC, series) AS k FROM (
  SELECT repo, branch, series, count(DISTINCT date) AS dates FROM m GROUP BY 1, 2, 3)),
s AS (SELECT m.* FROM m SEMI JOIN (SELECT * FROM act WHERE k <= 2) t USING (repo, branch, series))"""
        + SMOOTH_BODY.replace("min(date) AS lo, max(date) - min(date) AS span FROM s", "min(date) AS lo, max(date) - min(date) AS span FROM rev WHERE date <> 0"),
    )
)
def win8_smoothing(spark, folder):
    curve = reports.activity(adapters.orders_log(spark, folder), "directories", changes=True, n=2)
    return curve.select(*LINE, "series", "point", r6("x").alias("x"), r6("y").alias("y"))


@check(
    sql(
        "rev",
        """SELECT repo, branch, CAST(epoch(s) AS BIGINT) AS slot FROM (SELECT DISTINCT repo, branch FROM rev),
  generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) g(s)""",
    )
)
def win9_slot_spine(spark, folder):
    log = adapters.orders_log(spark, folder)
    return series.slot_spine(series.history_lines(log), 788918400, ORDERS_AS_OF, "days")


@check(
    sql(
        "rev",
        PIE_SQL.format(amount="1", source="rev", top=6)
        + f""" SELECT repo, branch, author, rank, round({_SHARE.format('upto - n')}, 6) AS arc_from, round({_SHARE.format('upto')}, 6) AS arc_to,
  CAST(floor(100 * {_SHARE.format('n')} + 0.5) AS BIGINT) AS pct FROM c""",
    )
)
def win10_arcs(spark, folder):
    pie = reports.authors_pie(adapters.orders_log(spark, folder))
    return pie.select(*LINE, "author", "rank", r6("arc_from").alias("arc_from"), r6("arc_to").alias("arc_to"), "pct")


@check(
    sql(
        "fc",
        """WITH a AS (SELECT rev.repo, branch, split_part(path, '/', 1) AS kind, CAST(sum(lines_added) AS BIGINT) AS n FROM rev JOIN fc USING (repo, id) GROUP BY 1, 2, 3)
SELECT repo, branch, kind, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 6) AS share FROM a WINDOW w AS (PARTITION BY repo, branch)""",
    )
)
def win11_ratio_to_total(spark, folder):
    log = adapters.orders_log(spark, folder)
    touched = log.file_changes.join(log.revisions.select(*LINE, "id"), REV)
    sizes = touched.groupBy(*LINE, F.substring_index("path", "/", 1).alias("kind")).agg(F.sum("lines_added").alias("n"))
    return ranking.normalize(sizes, LINE, "n").withColumn("share", r6("share"))
