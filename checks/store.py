"""Incremental store and interval coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import crc32_sql, registry, sql
from revlens.model import REV
from revlens.operators import filed, intervals, manifest, requests, store
from revlens.session import scratch_path
from revlens.sources import adapters

ENTRIES, check = registry()


@check(sql("rev fc", "SELECT rev.repo, count(h.id) AS hits, count(*) - count(h.id) AS misses FROM rev LEFT JOIN (SELECT DISTINCT repo, id FROM fc) h USING (repo, id) GROUP BY 1"))
def inc1_hit_counts(spark, folder):
    log = adapters.orders_log(spark, folder)
    return store.hit_counts(log.revisions, log.file_changes)


@check(sql("ev", "SELECT repo, id, seq, date, author, message FROM ev"))
def inc1_append_new(spark, folder):
    """Views are stored first; then everything is offered, and only the rest is added."""
    path = scratch_path(spark, "store")
    revs = adapters.events_log(spark, folder).revisions.select(*REV, "seq", "date", "author", "message")
    store.append_new(revs.where("message = 'view'"), path)
    return store.append_new(revs.unionByName(revs), path)


@check(sql("ev", "SELECT repo, id, seq, date, author, message FROM ev"))
def inc1_filed_append(spark, folder):
    """As ``inc1_append_new``, on a store that opens only files that may hold the ids."""
    path = scratch_path(spark, "filed")
    revs = adapters.events_log(spark, folder).revisions.select(*REV, "seq", "date", "author", "message")
    filed.append(revs.where("message = 'view'"), path)
    return filed.append(revs.unionByName(revs), path)


@check(
    sql(
        "ev",
        """WITH n AS (SELECT seq % 4 AS batch, count(*) AS offered, count(*) AS added FROM ev GROUP BY 1)
SELECT batch, offered, added, CAST(coalesce(sum(added) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS store_rows,
  CAST(0 AS BIGINT) AS rows_read FROM n
UNION ALL SELECT 4, offered, 0, (SELECT count(*) FROM ev), offered FROM n WHERE batch = 0""",
    )
)
def inc1_append_report(spark, folder):
    """Four appends of new revisions read no stored row; the first one again reads its own files only."""
    path = scratch_path(spark, "filed")
    revs = adapters.events_log(spark, folder).revisions.select(*REV, "seq")
    for k in (0, 1, 2, 3, 0):
        filed.append(revs.where(F.col("seq") % 4 == k), path)
    return filed.reports(spark, path).select("batch", "offered", "added", "store_rows", "rows_read")


_PAYLOAD = "p AS (SELECT repo, id, seq, id || ':' || date || ':' || author || ':' || message AS payload FROM ev)"


@check(
    sql(
        "ev",
        f"""WITH {_PAYLOAD}, c AS (SELECT *, {crc32_sql('payload')} AS good FROM p)
SELECT repo, id, good + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END AS crc, CASE WHEN seq % 97 = 0 THEN 'corrupted' ELSE 'ok' END AS status FROM c""",
    )
)
def inc2_audit(spark, folder):
    return store.audit(adapters.event_payloads(spark, folder)).select(*REV, "crc", "status")


@check(sql("ev", f"WITH {_PAYLOAD} SELECT * FROM p WHERE seq % 97 <> 0"))
def inc3_repair(spark, folder):
    path = scratch_path(spark, "sealed")
    adapters.event_payloads(spark, folder).write.parquet(path)
    return store.repair(spark, path, scratch_path(spark, "repaired")).drop("crc")


@check(
    """WITH v AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) - 1 AS version, b AS backend FROM lineitem, (VALUES ('git'), ('subversion'), ('mercurial')) x(b))
SELECT version, backend, CASE WHEN version <= 0 THEN 'unknown' WHEN version <= 1 THEN 'out of date' WHEN version <= 2 AND backend = 'subversion' THEN 'out of date'
  WHEN version <= 4 AND backend = 'git' THEN 'out of date' WHEN version <= 5 THEN 'ok' ELSE 'unknown' END AS status FROM v"""
)
def inc4_version_gate(spark, folder):
    lines = adapters.table(spark, folder, "lineitem").select((F.col("l_linenumber") - 1).alias("version"))
    names = F.explode(F.array(*[F.lit(n) for n in ("git", "subversion", "mercurial")]))
    pairs = lines.distinct().select("version", names.alias("backend"))
    return pairs.withColumn("status", store.version_status(F.col("version"), F.col("backend")))


_ISLANDS = """WITH u AS (SELECT repo, start, max("end") AS "end" FROM iv GROUP BY 1, 2),
f AS (SELECT *, max("end") OVER (PARTITION BY repo ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY start) AS island FROM f),
merged AS (SELECT repo, min(start) AS start, max("end") AS "end" FROM g GROUP BY repo, island)"""


@check(sql("iv", _ISLANDS.format(slack="") + " SELECT * FROM merged"))
def inc5_coalesce(spark, folder):
    return intervals.coalesce_intervals(adapters.order_intervals(spark, folder), ["repo"])


@check(sql("iv", _ISLANDS.format(slack="+ 1") + " SELECT * FROM merged"))
def inc5_coalesce_adjacent(spark, folder):
    return intervals.coalesce_intervals(adapters.order_intervals(spark, folder), ["repo"], merge_adjacent=True)


def _sparse(spark, folder):
    """Short intervals with room between them."""
    revs = adapters.order_revisions(spark, folder)
    width = F.pmod(F.col("author").cast("long"), F.lit(4))
    return revs.select("repo", F.col("seq").alias("start"), (F.col("seq") + width).alias("end"))


def _request(spark, folder):
    """Per repository everything from 100 before its first order to 100 after its last one."""
    revs = adapters.order_revisions(spark, folder)
    return revs.groupBy("repo").agg((F.min("seq") - 100).alias("start"), (F.max("seq") + 100).alias("end"))


_SPARSE = """sv AS (SELECT repo, seq AS start, seq + CAST(author AS BIGINT) % 4 AS "end" FROM rev),
req AS (SELECT repo, min(seq) - 100 AS lo, max(seq) + 100 AS hi FROM rev GROUP BY 1)"""


@check(
    sql(
        "rev",
        f"""WITH {_SPARSE}, n AS (SELECT repo, unnest(range(lo, hi + 1)) AS i FROM req),
open AS (SELECT n.repo, i FROM n ANTI JOIN (SELECT DISTINCT repo, unnest(range(start, "end" + 1)) AS i FROM sv) c USING (repo, i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY repo ORDER BY i) AS k FROM open)
SELECT repo, min(i) AS start, max(i) AS "end" FROM g GROUP BY repo, k""",
    )
)
def inc6_missing(spark, folder):
    return intervals.missing_intervals(_sparse(spark, folder), _request(spark, folder), ["repo"])


@check(
    sql(
        "rev",
        f"""WITH {_SPARSE} SELECT DISTINCT i.repo, i.id FROM (SELECT repo, seq + 2 AS id FROM rev) i JOIN req USING (repo)
  JOIN (SELECT DISTINCT repo, unnest(range(start, "end" + 1)) AS id FROM sv) c ON c.repo = i.repo AND c.id = i.id WHERE i.id BETWEEN lo AND hi""",
    )
)
def inc7_served(spark, folder):
    ids = adapters.order_revisions(spark, folder).select("repo", (F.col("seq") + 2).alias("id"))
    return intervals.ids_served(_sparse(spark, folder), ids, _request(spark, folder), ["repo"])


def _requests(spark, folder):
    """A request for each order, round it; every third one is asked of the same repository."""
    revs = adapters.order_revisions(spark, folder)
    repo = F.when(F.col("seq") % 3 == 0, "BUILDING").otherwise(F.col("repo"))
    width = F.col("author").cast("long") % 60
    return revs.select(repo.alias("repo"), F.col("seq").alias("req"), (F.col("seq") - 20).alias("start"), (F.col("seq") - 20 + width).alias("end"))


_REQUESTS = """sv AS (SELECT repo, seq AS start, seq + CAST(author AS BIGINT) % 4 AS "end" FROM rev),
req AS (SELECT CASE WHEN seq % 3 = 0 THEN 'BUILDING' ELSE repo END AS repo, seq AS req, seq - 20 AS lo, seq - 20 + CAST(author AS BIGINT) % 60 AS hi FROM rev),
cov AS (SELECT DISTINCT repo, unnest(range(start, "end" + 1)) AS i FROM sv)"""


@check(
    sql(
        "rev",
        f"""WITH {_REQUESTS}, n AS (SELECT repo, req, unnest(range(lo, hi + 1)) AS i FROM req),
g AS (SELECT n.repo, req, i, i - row_number() OVER (PARTITION BY n.repo, req ORDER BY i) AS k FROM n ANTI JOIN cov ON cov.repo = n.repo AND cov.i = n.i)
SELECT repo, req, min(i) AS start, max(i) AS "end" FROM g GROUP BY repo, req, k""",
    )
)
def inc6_missing_requests(spark, folder):
    return requests.missing_parts(_sparse(spark, folder), _requests(spark, folder), ["repo"])


@check(
    sql(
        "rev",
        f"""WITH {_REQUESTS}, ids AS (SELECT repo, seq + 2 AS id FROM rev)
SELECT req.repo, req, id FROM req JOIN ids ON ids.repo = req.repo AND id BETWEEN lo AND hi JOIN cov ON cov.repo = ids.repo AND cov.i = id""",
    )
)
def inc7_served_requests(spark, folder):
    ids = adapters.order_revisions(spark, folder).select("repo", (F.col("seq") + 2).alias("id"))
    return requests.served_ids(_sparse(spark, folder), ids, _requests(spark, folder), ["repo"])


def _sealed_in_four(spark, folder, path, numbers):
    own = adapters.event_payloads(spark, folder)
    for k in numbers:
        own.where(F.col("seq") % 4 == k).write.mode("append").parquet(path)
    return own.schema


@check(
    sql(
        "ev",
        """SELECT CASE WHEN seq % 4 = 3 THEN 1 ELSE 0 END AS checked, count(*) AS n, count(*) FILTER (seq % 97 = 0) AS bad FROM ev GROUP BY 1""",
    )
)
def inc2_changed_files(spark, folder):
    """Three appends, an audit, a fourth append, an audit: the second one reads the files of the last append alone."""
    path = scratch_path(spark, "audited")
    schema = _sealed_in_four(spark, folder, path, (0, 1, 2))
    manifest.audit_files(spark, path, schema)
    _sealed_in_four(spark, folder, path, (3,))
    found = manifest.audit_files(spark, path, schema)
    return found.groupBy(F.col("checked").cast("int").alias("checked")).agg(F.sum("rows").alias("n"), F.sum("bad").alias("bad"))


@check(ENTRIES["inc3_repair"].sql)
def inc3_repair_files(spark, folder):
    path = scratch_path(spark, "mended")
    schema = _sealed_in_four(spark, folder, path, (0, 1, 2, 3))
    manifest.audit_files(spark, path, schema)
    return manifest.repair_files(spark, path, schema).drop("crc")
