"""Registry helper and the SQL twins of the table adapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference moments: midnight after the last order day, and after the last event day.
ORDERS_AS_OF = 996710400  # 2001-08-02
EVENTS_AS_OF = 1706745600  # 2024-02-01


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def registry():
    entries: dict[str, Entry] = {}

    def add(sql: str | None = None):
        def wrap(fn):
            entries[fn.__name__] = Entry(fn, sql)
            return fn

        return wrap

    return entries, add


def r6(column: Column | str) -> Column:
    """Six decimals: doubles are compared after rounding."""
    return F.round(column, 6)


_PARTS = {
    "rev": """rev AS (
  SELECT c_mktsegment AS repo, o_orderstatus AS branch, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq,
         CAST(epoch(o_orderdate) AS BIGINT) AS date, CAST(o_custkey AS VARCHAR) AS author, o_orderpriority AS message
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "fc": """fc AS (
  SELECT repo, id, path, bytes_added, lines_added, bytes_removed, lines_removed FROM (
    SELECT l_orderkey, lower(p_type) || '/' || p_brand || '/' || replace(p_name, ' ', '.') AS path,
      CAST(sum(CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice) ELSE 0 END) AS BIGINT) AS bytes_added,
      CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS lines_added,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_extendedprice) ELSE 0 END) AS BIGINT) AS bytes_removed,
      CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS lines_removed
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) x JOIN rev ON seq = l_orderkey
  WHERE bytes_added + lines_added + bytes_removed + lines_removed <> 0)""",
    "tot": """tot AS (
  SELECT rev.*, coalesce(files, 0) AS files, coalesce(ba, 0) AS bytes_added, coalesce(la, 0) AS lines_added,
         coalesce(br, 0) AS bytes_removed, coalesce(lr, 0) AS lines_removed
  FROM rev LEFT JOIN (
    SELECT repo, id, count(*) AS files, CAST(sum(bytes_added) AS BIGINT) AS ba, CAST(sum(lines_added) AS BIGINT) AS la,
           CAST(sum(bytes_removed) AS BIGINT) AS br, CAST(sum(lines_removed) AS BIGINT) AS lr
    FROM fc GROUP BY 1, 2) s USING (repo, id))""",
    "br": """br AS (
  SELECT repo, branch, id AS head_id, branch = 'F' AS is_default FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY date DESC, seq DESC) AS k FROM rev) WHERE k = 1)""",
    "tags": """tags AS (
  SELECT repo, name, id FROM (
    SELECT repo, id, strftime(to_timestamp(date) AT TIME ZONE 'UTC', 'v%Y.%m') AS name,
      row_number() OVER (PARTITION BY repo, strftime(to_timestamp(date) AT TIME ZONE 'UTC', 'v%Y.%m') ORDER BY date, seq) AS k
    FROM rev) WHERE k = 1)""",
    "ev": """ev AS (
  SELECT 'events' AS repo, 'main' AS branch, CAST(event_id AS VARCHAR) AS id, event_id AS seq,
         epoch_us(ts) // 1000000 AS date, CAST(user_id AS VARCHAR) AS author, event_type AS message FROM events)""",
    "docs": """docs AS (
  SELECT 'documents' AS repo, lang AS branch, CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, CAST(0 AS BIGINT) AS date,
         source AS author, text AS message FROM documents)""",
    "conv": """conv AS (
  SELECT 'conversations' AS repo, 'main' AS branch, CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS id,
         conv_id * 2147483648 + turn AS seq, role AS author, text AS message FROM conversations)""",
    "tree": """tree AS (
  SELECT 'pages' AS repo, 'HEAD' AS id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages)""",
    "iv": """iv AS (
  SELECT c_mktsegment AS repo, o_orderkey AS start, o_orderkey + o_custkey % 40 AS "end"
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
}
_NEEDS = {"fc": ["rev"], "tot": ["fc"], "br": ["rev"], "tags": ["rev"]}


def sql(parts: str, body: str) -> str:
    """``body`` behind the named table definitions and all they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in parts.split():
        visit(name)
    definitions = [_PARTS[name] for name in ordered]
    body = body.strip()
    if body.startswith("WITH "):
        definitions.append(body[5:])
        return "WITH " + ",\n".join(definitions)
    return ("WITH " + ",\n".join(definitions) + "\n" if definitions else "") + body


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's bytes: DuckDB has no such function.

    The bytes are listed once, as pairs of hex digits, and folded through a table that is worked out bit by bit.
    """
    table = "list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"
    data = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    fold = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS BIGINT) + 1]))"
    return f"(SELECT xor({fold}, 4294967295) FROM (SELECT {table} AS crc_table))"


# Day of an epoch column, as a DATE.
def day(column: str) -> str:
    return f"CAST(to_timestamp({column}) AT TIME ZONE 'UTC' AS DATE)"


def day_epoch(date: str) -> str:
    return f"CAST(epoch({date}) AS BIGINT)"


def slot_sql(date: str, resolution: str) -> str:
    """Slot start of a DATE expression, as epoch seconds."""
    start = {
        "days": date,
        "weeks": f"({date} - CAST(dayofweek({date}) AS INTEGER))",
        "months": f"CAST(date_trunc('month', {date}) AS DATE)",
        "years": f"CAST(date_trunc('year', {date}) AS DATE)",
    }[resolution]
    return day_epoch(start)


def label_sql(date: str, resolution: str) -> str:
    return {
        "days": f"strftime({date}, '%Y-%m-%d')",
        "weeks": f"'Week ' || CAST(CAST(floor(1 + dayofyear({date}) / 7.0) AS BIGINT) AS VARCHAR) || ', ' || CAST(year({date}) AS VARCHAR)",
        "months": f"strftime({date}, '%b %y')",
        "years": f"CAST(year({date}) AS VARCHAR)",
    }[resolution]
