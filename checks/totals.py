"""Aggregations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ORDERS_AS_OF, day, registry, r6, slot_sql, sql
from revlens.model import LINE, REV, STAT_COLUMNS
from revlens.operators import ranking, totals
from revlens.plans import reports
from revlens.sources import adapters, tables

ENTRIES, check = registry()


def _totals(log):
    return totals.revision_totals(log.revisions, log.file_changes)


@check(sql("tot", "SELECT repo, branch, id, files, bytes_added, lines_added, bytes_removed, lines_removed FROM tot"))
def agg1_revision_totals(spark, folder):
    return _totals(adapters.orders_log(spark, folder)).select(*LINE, "id", "files", *STAT_COLUMNS)


@check(
    sql(
        "fc",
        """WITH want AS (SELECT repo, id, min(path) AS path FROM fc GROUP BY 1, 2 UNION ALL SELECT repo, id, 'no/such.file' FROM rev)
SELECT repo, id, path, coalesce(bytes_added, 0) AS bytes_added, coalesce(lines_added, 0) AS lines_added,
  coalesce(bytes_removed, 0) AS bytes_removed, coalesce(lines_removed, 0) AS lines_removed FROM want LEFT JOIN fc USING (repo, id, path)""",
    )
)
def agg2_file_totals(spark, folder):
    log = adapters.orders_log(spark, folder)
    first = log.file_changes.groupBy(*REV).agg(F.min("path").alias("path"))
    absent = log.revisions.select(*REV, F.lit("no/such.file").alias("path"))
    return totals.file_totals(log.file_changes, first.unionByName(absent))


@check(sql("rev", "SELECT repo, branch, author, count(*) AS commits FROM rev WHERE author <> '' GROUP BY 1, 2, 3"))
def agg3_commits_by_author(spark, folder):
    return totals.commits_by_author(adapters.order_revisions(spark, folder))


@check(sql("tot", "SELECT repo, branch, author, CAST(sum(lines_added) AS BIGINT) AS loc FROM tot WHERE author <> '' GROUP BY 1, 2, 3"))
def agg4_lines_by_author(spark, folder):
    return totals.lines_by_author(_totals(adapters.orders_log(spark, folder)))


@check(sql("tot", "SELECT repo, branch, author, CAST(sum(lines_added + lines_removed) AS BIGINT) AS churn FROM tot GROUP BY 1, 2, 3"))
def agg5_churn(spark, folder):
    return totals.churn(_totals(adapters.orders_log(spark, folder)), LINE + ["author"])


@check(sql("tot", "SELECT repo, branch, date, CAST(sum(lines_added - lines_removed) AS BIGINT) AS delta FROM tot WHERE date <> 0 GROUP BY 1, 2, 3"))
def agg6_net_by_date(spark, folder):
    return totals.net_by_date(_totals(adapters.orders_log(spark, folder)))


@check(
    sql(
        "fc",
        """SELECT rev.repo, branch, '/' || regexp_replace(path, '/[^/]*$', '') AS directory, CAST(sum(lines_added - lines_removed) AS BIGINT) AS loc
FROM fc JOIN rev USING (repo, id) GROUP BY 1, 2, 3""",
    )
)
def agg7_net_by_directory(spark, folder):
    log = adapters.orders_log(spark, folder)
    return totals.net_by_directory(totals.touches(log.revisions, log.file_changes))


def _activity_sql(series, amount, source, parts):
    return sql(parts, f"SELECT repo, branch, {series} AS series, date, CAST(sum({amount}) AS BIGINT) AS n FROM {source} WHERE date <> 0 GROUP BY 1, 2, 3, 4")


_TOUCHED = "(SELECT rev.repo, branch, date, path, lines_added, lines_removed FROM rev JOIN fc USING (repo, id))"
_LINES = "lines_added + lines_removed"
_DIR = "'/' || regexp_replace(path, '/[^/]*$', '')"


def _activity(spark, folder, split, changes):
    log = adapters.orders_log(spark, folder)
    return totals.activity_counts(log, log.revisions, split, changes)


@check(_activity_sql("'all'", "1", "rev", "rev"))
def agg8_activity(spark, folder):
    return _activity(spark, folder, "none", False)


@check(_activity_sql("author", _LINES, "tot", "tot"))
def agg8_activity_by_author(spark, folder):
    return _activity(spark, folder, "authors", True)


@check(_activity_sql("path", "1", _TOUCHED, "fc"))
def agg8_activity_by_file(spark, folder):
    return _activity(spark, folder, "files", False)


@check(_activity_sql(_DIR, _LINES, _TOUCHED, "fc"))
def agg8_activity_by_directory(spark, folder):
    return _activity(spark, folder, "directories", True)


EXT_SQL = """CASE WHEN regexp_extract(name, '^.*(\\..+)$', 1) IN ('', name) THEN NULL ELSE lower(regexp_extract(name, '^.*(\\..+)$', 1)) END"""
LANGUAGE_SQL = f"""CASE ext WHEN '.html' THEN 'HTML' WHEN '.htm' THEN 'HTML' WHEN '.xhtml' THEN 'HTML' WHEN '.py' THEN 'Python' WHEN '.php' THEN 'PHP'
  WHEN '.txt' THEN 'Text' WHEN '.js' THEN 'JavaScript' ELSE coalesce(upper(substr(ext, 2)), 'unknown') END"""
LANGUAGES_SQL = f"""WITH named AS (SELECT repo, id, path, regexp_replace(path, '^.*/', '') AS name FROM tree),
exts AS (SELECT repo, id, path, {EXT_SQL} AS ext FROM named),
lang AS (SELECT repo, {LANGUAGE_SQL} AS language, count(*) AS n FROM exts GROUP BY 1, 2)"""


@check(sql("tree", f"{LANGUAGES_SQL} SELECT * FROM lang"))
def agg9_files_by_language(spark, folder):
    return totals.files_by_language(tables.tree(adapters.pages_log(spark, folder)))


PUNCH_SQL = """WITH c AS (SELECT repo, branch, CAST(dayofweek(to_timestamp(date) AT TIME ZONE 'UTC') AS INTEGER) AS dow,
  CAST(hour(to_timestamp(date) AT TIME ZONE 'UTC') AS INTEGER) AS hour, count(*) AS n FROM ev {where} GROUP BY 1, 2, 3, 4)
SELECT *, round(n / (2.0 * max(n) OVER (PARTITION BY repo, branch)), 6) AS size FROM c"""


@check(sql("ev", PUNCH_SQL.format(where="WHERE date <> 0")))
def agg10_punchcard(spark, folder):
    return totals.punchcard(adapters.events_log(spark, folder).revisions).withColumn("size", r6("size"))


@check(
    sql(
        "tot",
        f"SELECT repo, branch, {slot_sql(day('date'), 'years')} AS slot, count(*) AS commits, CAST(sum(files) AS BIGINT) AS changes FROM tot GROUP BY 1, 2, 3",
    )
)
def agg11_slot_counts(spark, folder):
    return totals.slot_counts(_totals(adapters.orders_log(spark, folder)), "years")


@check(
    sql(
        "tot",
        f"""SELECT repo, branch, {slot_sql(day('date'), 'months')} AS slot, CAST(sum(CASE WHEN author = '7' THEN lines_added ELSE 0 END) AS BIGINT) AS own,
  CAST(sum(CASE WHEN author = '7' THEN 0 ELSE lines_added END) AS BIGINT) AS others FROM tot GROUP BY 1, 2, 3""",
    )
)
def agg12_participation(spark, folder):
    return totals.participation(_totals(adapters.orders_log(spark, folder)), "7", "months", changes=True)


VOLUME_SQL = """WITH slot(slot, first) AS (VALUES ('All Time', CAST(-1 AS BIGINT)), ('Past 12 months', {year}), ('This month', {month})),
cell AS (SELECT repo, branch, slot, author, CAST(sum({amount}) AS BIGINT) AS v FROM {source} JOIN slot ON date >= first GROUP BY 1, 2, 3, 4),
a AS (SELECT repo, branch, author, sum(v) AS v, row_number() OVER (PARTITION BY repo, branch ORDER BY sum(v) DESC, author) AS k FROM cell GROUP BY 1, 2, 3),
top AS (SELECT * FROM a WHERE k <= {n}),
t AS (SELECT l.repo, l.branch, slot.slot, coalesce(v, 0) AS total FROM (SELECT DISTINCT repo, branch FROM {source}) l CROSS JOIN slot
  LEFT JOIN (SELECT repo, branch, slot, sum(v) AS v FROM cell GROUP BY 1, 2, 3) s ON s.repo = l.repo AND s.branch = l.branch AND s.slot = slot.slot),
shown AS (SELECT t.repo, t.branch, t.slot, top.author, CAST(k AS INTEGER) AS rank, coalesce(v.v, 0) AS v, total FROM t
  JOIN top ON top.repo = t.repo AND top.branch = t.branch
  LEFT JOIN cell v ON v.repo = t.repo AND v.branch = t.branch AND v.slot = t.slot AND v.author = top.author),
rest AS (SELECT repo, branch, slot, sum(v) AS kept, max(total) AS total, CAST(count(*) + 1 AS INTEGER) AS rank FROM shown GROUP BY 1, 2, 3),
open AS (SELECT repo, branch FROM rest GROUP BY 1, 2 HAVING bool_or(kept < total OR total = 0))
SELECT repo, branch, slot, author, rank, round(CASE WHEN total = 0 THEN 0 ELSE 100.0 * CAST(v AS DOUBLE) / CAST(total AS DOUBLE) END, 6) AS pct FROM shown
UNION ALL SELECT repo, branch, slot, 'Others', rank, round(CASE WHEN total = 0 THEN 100 ELSE 100.0 * CAST(total - kept AS DOUBLE) / CAST(total AS DOUBLE) END, 6)
FROM rest SEMI JOIN open USING (repo, branch)"""


def _volume_orders_sql(amount, n):
    return sql("tot", VOLUME_SQL.format(amount=amount, source="tot", year=967766400, month=996624000, n=n))


@check(_volume_orders_sql(_LINES, 3))
def agg13_volume_shares(spark, folder):
    rows = reports.volume(adapters.orders_log(spark, folder), ORDERS_AS_OF, n=3, changes=True)
    return rows.withColumn("pct", r6("pct"))


PIE_SQL = """WITH a AS (SELECT repo, branch, author, CAST(sum({amount}) AS BIGINT) AS n FROM {source} WHERE author <> '' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY n DESC, author) AS k, sum(n) OVER (PARTITION BY repo, branch) AS total FROM a),
p AS (SELECT repo, branch, author, CAST(k AS INTEGER) AS rank, n, total FROM r WHERE k <= {top}
  UNION ALL SELECT repo, branch, 'Others', CAST(count(*) FILTER (k <= {top}) + 1 AS INTEGER), CAST(coalesce(sum(n) FILTER (k > {top}), 0) AS BIGINT), max(total) FROM r
  GROUP BY 1, 2 HAVING coalesce(sum(n) FILTER (k > {top}), 0) > 0.00001 * max(total)),
c AS (SELECT *, sum(n) OVER (PARTITION BY repo, branch ORDER BY rank) AS upto FROM p)"""
_SHARE = "CAST({0} AS DOUBLE) / CAST(total AS DOUBLE)"


@check(
    sql(
        "tot",
        PIE_SQL.format(amount="lines_added", source="tot", top=5)
        + f" SELECT repo, branch, author, rank, n, CAST(total AS BIGINT) AS total, round({_SHARE.format('n')}, 6) AS share FROM c",
    )
)
def agg14_shares(spark, folder):
    sizes = totals.lines_by_author(_totals(adapters.orders_log(spark, folder))).withColumnRenamed("loc", "n")
    return ranking.shares(sizes, LINE, "author", "n", 5).withColumn("share", r6("share")).drop("is_rest")


@check(
    sql(
        "fc",
        """WITH a AS (SELECT repo, path, CAST(sum(lines_removed) AS BIGINT) AS n FROM fc GROUP BY 1, 2)
SELECT repo, path, n, round(CASE WHEN sum(n) OVER w = 0 THEN n ELSE CAST(n AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE) END, 6) AS share FROM a WINDOW w AS (PARTITION BY repo)""",
    )
)
def agg15_normalize(spark, folder):
    sizes = adapters.order_changes(spark, folder).groupBy("repo", "path").agg(F.sum("lines_removed").alias("n"))
    return ranking.normalize(sizes, ["repo"], "n").withColumn("share", r6("share"))


@check(sql("rev", "SELECT repo, branch, min(date) AS first_date, max(date) AS last_date FROM rev WHERE date <> 0 GROUP BY 1, 2"))
def agg16_date_extent(spark, folder):
    return totals.date_extent(adapters.order_revisions(spark, folder))


@check(sql("rev", "SELECT repo, id, date AS born FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS k FROM rev) WHERE k = 1"))
def agg17_first_revision(spark, folder):
    return totals.first_revision(adapters.order_revisions(spark, folder))


@check(sql("docs", "SELECT repo, branch, author, seq, message, count(*) OVER (PARTITION BY repo, branch, author) AS commits FROM docs WHERE author <> ''"))
def agg18_messages_by_author(spark, folder):
    return totals.messages_by_author(adapters.documents_log(spark, folder).revisions)


@check(
    sql(
        "fc",
        """SELECT repo, id, CAST(max(length(path)) AS INTEGER) AS max_len, max(lines_added + lines_removed) AS max_change, count(*) AS files,
  CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed FROM fc GROUP BY 1, 2""",
    )
)
def agg19_layout_stats(spark, folder):
    return totals.layout_stats(adapters.order_changes(spark, folder))


@check(
    sql(
        "tot",
        """SELECT repo, branch, id, ' ' || files || ' file' || CASE WHEN files <> 1 THEN 's' ELSE '' END || ' changed'
  || CASE WHEN lines_added > 0 THEN ', ' || lines_added || CASE WHEN lines_added > 1 THEN ' insertions(+)' ELSE ' insertion(+)' END ELSE '' END
  || CASE WHEN lines_removed > 0 THEN ', ' || lines_removed || CASE WHEN lines_removed > 1 THEN ' deletions(-)' ELSE ' deletion(-)' END ELSE '' END AS summary FROM tot""",
    )
)
def agg20_summary_line(spark, folder):
    return totals.summary_lines(_totals(adapters.orders_log(spark, folder)))


@check(sql("rev", "SELECT repo, branch, author, count(*) AS commits FROM rev GROUP BY 1, 2, 3 ORDER BY commits DESC, author, repo, branch LIMIT 6"))
def top1_authors(spark, folder):
    counts = totals.commits_by_author(adapters.order_revisions(spark, folder))
    return ranking.top_n(counts, "commits", ["author", *LINE])


@check(
    sql(
        "rev",
        """SELECT repo, branch, author, n, CASE WHEN length(CAST(n AS VARCHAR)) < 6 THEN lpad(CAST(n AS VARCHAR), 6, ' ') ELSE CAST(n AS VARCHAR) END || chr(9) || author AS line
FROM (SELECT repo, branch, author, count(*) AS n FROM rev GROUP BY 1, 2, 3)""",
    )
)
def top2_author_order(spark, folder):
    return reports.shortlog(adapters.orders_log(spark, folder), summary=True, numbered=True)


@check(sql("rev", "SELECT repo, branch, date, seq, id, author FROM rev"))
def top3_by_date(spark, folder):
    revs = adapters.order_revisions(spark, folder).select(*LINE, "date", "seq", "id", "author")
    return revs.orderBy(*LINE, "date", "seq")


@check(
    sql(
        "tree",
        f"""{LANGUAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS k FROM lang),
b AS (SELECT *, max(k) OVER (PARTITION BY repo) AS last, max(CASE WHEN language = 'unknown' THEN k END) OVER (PARTITION BY repo) AS spot FROM r WHERE k <= 6)
SELECT repo, language, n, CAST(CASE WHEN spot IS NULL THEN k WHEN k = spot THEN last WHEN k = last THEN spot ELSE k END AS INTEGER) AS rank FROM b""",
    )
)
def top4_unknown_last(spark, folder):
    return reports.filetypes(adapters.pages_log(spark, folder))


@check(sql("br", "SELECT * FROM br"))
def top5_branch_order(spark, folder):
    return reports.branch_order(adapters.orders_log(spark, folder).branches)


@check(sql("rev", "SELECT repo, branch, arg_min(id, seq) AS oldest, arg_max(id, seq) AS newest FROM rev GROUP BY 1, 2"))
def top6_end_revisions(spark, folder):
    return totals.end_revisions(adapters.order_revisions(spark, folder))


@check(
    sql(
        "rev",
        """WITH a AS (SELECT repo, branch, author, count(*) AS n, row_number() OVER (PARTITION BY repo, branch ORDER BY count(*) DESC, author) AS k FROM rev GROUP BY 1, 2, 3)
SELECT repo, branch, CASE WHEN k <= 6 THEN author ELSE 'Others' END AS author, CAST(sum(n) AS BIGINT) AS n, CAST(least(min(k), 7) AS INTEGER) AS rank FROM a GROUP BY 1, 2, 3""",
    )
)
def top7_with_others(spark, folder):
    counts = totals.commits_by_author(adapters.order_revisions(spark, folder)).withColumnRenamed("commits", "n")
    rows = ranking.top_n_and_others(counts, LINE, "author", "n", 6).where("not is_rest or n > 0")
    return rows.select(*LINE, "author", "n", "rank")
