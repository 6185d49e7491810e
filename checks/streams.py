"""Streams, drained and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import registry, sql
from checks.sources import ENTRIES as _SOURCES
from revlens.model import LINE, REV, STAT_COLUMNS
from revlens.operators import totals
from revlens.session import scratch_path, written
from revlens.sources import adapters
from revlens.streaming import feeds, slots

ENTRIES, check = registry()


def _feed(spark, folder, name):
    return feeds.feed(spark, f"{folder}/{name}.parquet", adapters.table(spark, folder, name).schema)


def _events(spark, folder):
    return adapters.event_revisions(_feed(spark, folder, "events"))


def _orders(spark, folder):
    return adapters.order_revisions(spark, folder, _feed(spark, folder, "orders"))


def _with_static_totals(spark, folder, revs):
    """A stream of revisions next to the totals of their changes, which are summed and stored once."""
    stored = written(totals.change_totals(adapters.order_changes(spark, folder)), "change-totals")
    joined = revs.join(stored, REV, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in STAT_COLUMNS})


_SHOWN = ["id", "seq", "date", "author", "message"]


@check(sql("ev", "SELECT repo, branch, id, seq, date, author, message FROM ev"))
def str1_feed(spark, folder):
    return feeds.append_to(_events(spark, folder).select(*LINE, *_SHOWN), scratch_path(spark, "feed"))


@check(sql("ev", "SELECT repo, branch, id, seq, date, author, message FROM ev"))
def str2_once_each(spark, folder):
    twice = _events(spark, folder).unionByName(_events(spark, folder))
    return feeds.once_each(twice.select(*LINE, *_SHOWN), scratch_path(spark, "once"))


@check(
    sql(
        "tot",
        """SELECT repo, branch, date // 86400 * 86400 AS slot, count(*) AS commits, CAST(sum(lines_added + lines_removed) AS BIGINT) AS churn
FROM tot GROUP BY 1, 2, 3""",
    )
)
def str3_slot_totals(spark, folder):
    rows = _with_static_totals(spark, folder, _orders(spark, folder))
    churn = F.col("lines_added") + F.col("lines_removed")
    return feeds.totals_so_far(rows, scratch_path(spark, "slots"), lambda batch: feeds.slot_totals(batch, churn), [*LINE, "slot"])


@check(ENTRIES["str3_slot_totals"].sql)
def str3_closing_slots(spark, folder):
    """Closed days with their corrections, and open ones as they stand."""
    rows = _with_static_totals(spark, folder, _orders(spark, folder))
    path = scratch_path(spark, "closing")
    slots.closing_slots(rows, F.col("lines_added") + F.col("lines_removed"), path)
    return slots.totals_now(spark, path)


@check(
    """SELECT 'events' AS repo, 'main' AS branch, slot, CASE WHEN slot + 3600 <= seen - 7200 THEN 'closed' ELSE 'open' END AS kind, count(*) AS commits
FROM (SELECT epoch_us(ts) // 3600000000 * 3600 AS slot, max(epoch_us(ts) // 1000000) OVER () AS seen FROM events) GROUP BY 1, 2, 3, 4"""
)
def str3_closed_hours(spark, folder):
    """Hours of events that have closed, two hours behind the newest event, and those still open."""
    path = scratch_path(spark, "hours")
    given = slots.closing_slots(_events(spark, folder), F.lit(0), path, width=3600, delay="2 hours")
    return given.unionByName(slots.still_open(spark, path)).drop("churn")


@check(sql("tot", "SELECT repo, branch, author, count(*) AS commits, CAST(sum(lines_added) AS BIGINT) AS loc FROM tot WHERE author <> '' GROUP BY 1, 2, 3"))
def str4_author_totals(spark, folder):
    rows = _with_static_totals(spark, folder, _orders(spark, folder))
    shape = lambda batch: feeds.author_totals(batch, F.col("lines_added"))
    return feeds.totals_so_far(rows, scratch_path(spark, "authors"), shape, [*LINE, "author"])


@check(
    """SELECT 'events' AS repo, 'main' AS branch, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n
FROM events GROUP BY 1, 2, 3, 4"""
)
def str5_punchcard(spark, folder):
    return feeds.totals_so_far(_events(spark, folder), scratch_path(spark, "punchcard"), feeds.punchcard_cells, [*LINE, "dow", "hour"])


@check(sql("ev", "SELECT repo, branch, id, seq, date, author, message FROM ev"))
def str6_store(spark, folder):
    twice = _events(spark, folder).unionByName(_events(spark, folder))
    return feeds.store_new(twice.select(*LINE, *_SHOWN), scratch_path(spark, "stream-store"))


@check(_SOURCES["src5_document_diffs"].sql)
def str7_diffs(spark, folder):
    patches = adapters.document_patches(spark, folder, _feed(spark, folder, "documents"))
    return feeds.parse_diffs(patches, scratch_path(spark, "diffs"))


@check(_SOURCES["src5_pieced_diffs"].sql)
def str7_pieced_diffs(spark, folder):
    """Pieces of the languages' diffs as a stream."""
    own = adapters.language_patches(spark, folder, documents=_feed(spark, folder, "documents"))
    return feeds.parse_pieces(own, scratch_path(spark, "pieces"))
