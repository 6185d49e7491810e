"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import EVENTS_AS_OF, ORDERS_AS_OF, crc32_sql, day, day_epoch, label_sql, registry, r6, slot_sql, sql
from checks.sources import NL, _LEGACY, _csv, _json
from checks.totals import EXT_SQL, LANGUAGE_SQL
from revlens.functions import paths, text, times
from revlens.sources import adapters

ENTRIES, check = registry()


def _paths(spark, folder):
    """File paths of all order lines and all page URLs, some with a trailing slash."""
    files = adapters.order_changes(spark, folder).select("path").distinct()
    urls = adapters.table(spark, folder, "pages").select(F.col("url").alias("path")).distinct()
    return files.unionByName(urls).unionByName(files.select(F.concat(F.lit("/"), "path", F.lit("//")).alias("path")))


_PATHS = """p AS (SELECT DISTINCT path FROM fc UNION ALL SELECT DISTINCT url FROM pages UNION ALL SELECT DISTINCT '/' || path || '//' FROM fc)"""


@check(
    sql(
        "fc",
        f"""WITH {_PATHS}, b AS (SELECT path, rtrim(path, '/') AS bare FROM p)
SELECT path, CASE WHEN NOT contains(bare, '/') THEN '.' WHEN regexp_matches(bare, '^/[^/]*$') THEN '/' ELSE regexp_replace(bare, '/[^/]*$', '') END AS dir FROM b""",
    )
)
def fn1_dirname(spark, folder):
    return _paths(spark, folder).select("path", paths.dirname(F.col("path")).alias("dir"))


@check(sql("fc", f"WITH {_PATHS} SELECT path, regexp_replace(rtrim(path, '/'), '^.*/', '') AS base FROM p"))
def fn2_basename(spark, folder):
    return _paths(spark, folder).select("path", paths.basename(F.col("path")).alias("base"))


_NAMES = f"n AS (SELECT path, regexp_replace(path, '^.*/', '') AS name FROM p), e AS (SELECT path, {EXT_SQL} AS ext FROM n)"


@check(sql("fc", f"WITH {_PATHS}, {_NAMES} SELECT path, coalesce(ext, '') AS ext FROM e"))
def fn3_extension(spark, folder):
    return _paths(spark, folder).select("path", F.coalesce(paths.extension(F.col("path")), F.lit("")).alias("ext"))


@check(sql("fc", f"WITH {_PATHS}, {_NAMES} SELECT path, {LANGUAGE_SQL} AS language FROM e"))
def fn4_language(spark, folder):
    return _paths(spark, folder).select("path", paths.language(F.col("path")).alias("language"))


@check(
    """SELECT doc_id, array_to_string(string_split(text, 'en'), '|') AS pieces, len(string_split(text, '.')) AS dots, length(text) AS chars,
  array_to_string(string_split(source, 'c'), '|') AS parts FROM documents"""
)
def fn5_split(spark, folder):
    docs = adapters.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.array_join(text.split(F.col("text"), "en"), "|").alias("pieces"),
        F.size(text.split(F.col("text"), ".")).cast("long").alias("dots"),
        F.size(text.split(F.col("text"), "")).cast("long").alias("chars"),
        F.array_join(text.split(F.col("source"), "c"), "|").alias("parts"),
    )


@check(f"SELECT doc_id, trim(chr(9) || ' ' || text || ' ' || {NL}, ' ' || chr(9) || {NL} || chr(13) || chr(11) || chr(12)) AS trimmed FROM documents")
def fn6_trim(spark, folder):
    padded = F.concat(F.lit("\t "), "text", F.lit(" \n"))
    return adapters.table(spark, folder, "documents").select("doc_id", text.trim(padded).alias("trimmed"))


@check(sql("fc", "SELECT DISTINCT path, array_to_string(string_split(path, '/'), '::') AS joined FROM fc"))
def fn7_join(spark, folder):
    rows = adapters.order_changes(spark, folder).select("path").distinct()
    return rows.select("path", text.join(text.split(F.col("path"), "/"), "::").alias("joined"))


@check(f"SELECT page_id, starts_with(url, 'https://') AS secure, ends_with(url, '.html') AS page FROM pages")
def fn8_starts_and_ends(spark, folder):
    pages = adapters.table(spark, folder, "pages")
    url = F.col("url")
    return pages.select("page_id", text.starts_with(url, "https://").alias("secure"), text.ends_with(url, ".html").alias("page"))


@check(sql("rev", "SELECT id, id AS child, author AS parent, id AS single, '' AS orphan FROM rev"))
def fn9_composite_ids(spark, folder):
    revs = adapters.order_revisions(spark, folder)
    both = F.concat_ws(":", "author", "id")
    return revs.select(
        "id",
        text.child_id(both).alias("child"),
        text.parent_id(both).alias("parent"),
        text.child_id(F.col("id")).alias("single"),
        F.coalesce(text.parent_id(F.col("id")), F.lit("")).alias("orphan"),
    )


@check(sql("ev", "SELECT id, 'User <' || author || '>' AS author FROM ev"))
def fn10_clean_author(spark, folder):
    revs = adapters.events_log(spark, folder).revisions
    raw = F.concat(F.lit("  User <"), "author", F.lit("> <u"), "author", F.lit("@x> "), F.col("date").cast("string"))
    return revs.select("id", text.clean_author(raw).alias("author"))


_SUMMARY = f"""trim(replace(CASE WHEN contains(message, {NL} || {NL}) THEN split_part(message, {NL} || {NL}, 1) ELSE split_part(message, {NL}, 1) END,
  {NL}, '    '), ' ' || chr(9) || {NL} || chr(13) || chr(11) || chr(12))"""
_MESSAGES = f"""m AS (SELECT 'd' || id AS id, message FROM docs UNION ALL SELECT 'c' || id, message FROM conv
  UNION ALL SELECT 'b' || id, replace(message, ', ', {NL}) || {NL} || {NL} || message FROM docs)"""


@check(sql("docs conv", f"WITH {_MESSAGES} SELECT id, {_SUMMARY} AS summary FROM m"))
def fn11_message_summary(spark, folder):
    docs = adapters.documents_log(spark, folder).revisions
    turns = adapters.conversations_log(spark, folder).revisions
    blank = F.concat(F.replace("message", F.lit(", "), F.lit("\n")), F.lit("\n\n"), "message")
    rows = (
        docs.select(F.concat(F.lit("d"), "id").alias("id"), "message")
        .unionByName(turns.select(F.concat(F.lit("c"), "id").alias("id"), "message"))
        .unionByName(docs.select(F.concat(F.lit("b"), "id").alias("id"), blank.alias("message")))
    )
    return rows.select("id", text.message_summary(F.col("message")).alias("summary"))


@check(f"SELECT doc_id, {_LEGACY.format('text')} AS legacy, {_csv('text')} AS csv, {_json('text')} AS json FROM documents UNION ALL SELECT -1 - page_id, {_LEGACY.format('html')}, {_csv('html')}, {_json('html')} FROM pages")
def fn12_escaping(spark, folder):
    docs = adapters.table(spark, folder, "documents").select("doc_id", "text")
    pages = adapters.table(spark, folder, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    body = F.col("text")
    return docs.unionByName(pages).select(
        "doc_id",
        text.escape_legacy_csv(body).alias("legacy"),
        text.quote_csv(body).alias("csv"),
        text.quote_json(body).alias("json"),
    )


@check(
    """WITH t AS (SELECT page_id, url, "right"(url, 27) AS tail FROM pages)
SELECT page_id, CASE WHEN length(url) > 30 THEN rpad('...' || CASE WHEN instr(tail, '/') > 0 THEN substr(tail, instr(tail, '/')) ELSE tail END, 30, ' ')
  ELSE rpad(url, 30, ' ') END AS short FROM t"""
)
def fn13_shorten_path(spark, folder):
    pages = adapters.table(spark, folder, "pages")
    return pages.select("page_id", paths.shorten_path(F.col("url"), F.lit(30)).alias("short"))


@check(
    """WITH b AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS width FROM lineitem)
SELECT n, width, repeat('+', CAST(floor(((n - 1) * (width - 1) + 50 - 1) / 49.0) AS BIGINT)) AS bar, repeat('-', n) AS flat FROM b"""
)
def fn14_change_bar(spark, folder):
    lines = adapters.table(spark, folder, "lineitem")
    pairs = lines.select(F.col("l_quantity").cast("long").alias("n"), F.col("l_linenumber").cast("long").alias("width")).distinct()
    n, width = F.col("n"), F.col("width")
    return pairs.select("n", "width", text.change_bar("+", n, width, F.lit(50)).alias("bar"), text.change_bar("-", n, width, F.lit(1)).alias("flat"))


@check(sql("fc", f"WITH {_PATHS} SELECT path, CASE WHEN length(path) > 1 THEN substr(path, 2) ELSE path END AS shown FROM p"))
def fn16_display_directory(spark, folder):
    return _paths(spark, folder).select("path", paths.display_directory(F.col("path")).alias("shown"))


@check(f"SELECT doc_id, {crc32_sql('text')} AS crc FROM documents")
def fn17_crc32(spark, folder):
    return adapters.table(spark, folder, "documents").select("doc_id", text.crc32(F.col("text")).alias("crc"))


@check(f"SELECT conv_id, turn, {crc32_sql('text')} AS crc FROM conversations")
def fn17_crc32_turns(spark, folder):
    return adapters.table(spark, folder, "conversations").select("conv_id", "turn", text.crc32(F.col("text")).alias("crc"))


@check("SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) AS date FROM orders")
def fn20_parse_date(spark, folder):
    orders = adapters.table(spark, folder, "orders")
    return orders.select("o_orderkey", times.parse_date(F.col("o_orderdate").cast("date").cast("string")).alias("date"))


def _both(spark, folder):
    orders = adapters.order_revisions(spark, folder).select("repo", "id", "date")
    return orders.unionByName(adapters.events_log(spark, folder).revisions.select("repo", "id", "date"))


_BOTH = "d AS (SELECT repo, id, date FROM rev UNION ALL SELECT repo, id, date FROM ev)"
_UNITS = ("days", "weeks", "months", "years")


@check(sql("rev ev", f"WITH {_BOTH} SELECT repo, id, " + ", ".join(f"{slot_sql(day('date'), u)} AS {u}" for u in _UNITS) + " FROM d"))
def fn24_time_slot(spark, folder):
    return _both(spark, folder).select("repo", "id", *[times.time_slot(F.col("date"), u).alias(u) for u in _UNITS])


@check(
    sql(
        "rev ev",
        f"""WITH {_BOTH}, c AS (SELECT *, {day('date')} AS d FROM d)
SELECT repo, id, date + 86400 AS days, date + 7 * 86400 AS weeks,
  date % 86400 + {day_epoch("date_trunc('month', d) + INTERVAL 1 MONTH")} + (day(d) - 1) * 86400 AS months,
  date % 86400 + {day_epoch("date_trunc('month', d) + INTERVAL 12 MONTH")} + (day(d) - 1) * 86400 AS years FROM c""",
    )
)
def fn25_next_slot(spark, folder):
    return _both(spark, folder).select("repo", "id", *[times.next_slot(F.col("date"), u).alias(u) for u in _UNITS])


@check(sql("rev ev", f"WITH {_BOTH} SELECT repo, id, " + ", ".join(f"{label_sql(day('date'), u)} AS {u}" for u in _UNITS) + " FROM d"))
def fn26_slot_label(spark, folder):
    return _both(spark, folder).select("repo", "id", *[times.slot_label(F.col("date"), u).alias(u) for u in _UNITS])


@check("SELECT event_id, round(hour(ts) + minute(ts) / 60.0, 6) AS hour_of_day FROM events")
def fn28_hour_of_day(spark, folder):
    revs = adapters.events_log(spark, folder).revisions
    return revs.select(F.col("seq").alias("event_id"), r6(times.hour_of_day(F.col("date"))).alias("hour_of_day"))


@check("SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def fn29_weekday_and_hour(spark, folder):
    revs = adapters.events_log(spark, folder).revisions
    return revs.select(F.col("seq").alias("event_id"), times.weekday(F.col("date")).alias("dow"), times.hour(F.col("date")).alias("hour"))


def _spans(spark, folder):
    """Ages in seconds: events from a second to a month, orders up to years."""
    revs = adapters.events_log(spark, folder).revisions.select("repo", "id", (F.lit(EVENTS_AS_OF) - F.col("date")).alias("span"))
    orders = adapters.order_revisions(spark, folder).select("repo", "id", (F.lit(ORDERS_AS_OF) - F.col("date")).alias("span"))
    early = adapters.events_log(spark, folder).revisions.select(
        F.lit("early").alias("repo"), "id", (F.col("date") - F.lit(1704067200)).alias("span")
    )
    return revs.unionByName(orders).unionByName(early)


_SPANS = f"""sp AS (SELECT repo, id, {EVENTS_AS_OF} - date AS span FROM ev UNION ALL SELECT repo, id, {ORDERS_AS_OF} - date FROM rev
  UNION ALL SELECT 'early', id, date - 1704067200 FROM ev)"""
HUMAN_SQL = """CASE WHEN mins < 2 THEN CASE WHEN span < 5 THEN 'less than 5 seconds' WHEN span < 10 THEN 'less than 10 seconds'
    WHEN span < 20 THEN 'less than 20 seconds' WHEN span < 40 THEN 'half a minute' WHEN span < 60 THEN 'less than a minute' ELSE '1 minute' END
  WHEN mins < 45 THEN mins || ' minutes' WHEN mins < 90 THEN 'about 1 hour' WHEN mins < 1440 THEN 'about ' || mins // 60 || ' hours'
  WHEN mins < 2530 THEN '1 day' WHEN mins < 43200 THEN mins // 1440 || ' days' WHEN mins < 86400 THEN 'about 1 month'
  WHEN mins < 525600 THEN mins // 43200 || ' months'
  ELSE CASE WHEN (mins - (mins // 525600) // 4 * 1440) % 525600 < 131400 THEN 'about ' ELSE 'over ' END || mins // 525600
    || CASE WHEN mins // 525600 = 1 AND (mins - (mins // 525600) // 4 * 1440) % 525600 < 394200 THEN ' year' ELSE ' years' END END"""


@check(sql("rev ev", f"WITH {_SPANS}, mm AS (SELECT *, CAST(floor(span / 60.0 + 0.5) AS BIGINT) AS mins FROM sp) SELECT repo, id, span, {HUMAN_SQL} AS words FROM mm"))
def fn30_human_distance(spark, folder):
    return _spans(spark, folder).select("repo", "id", "span", times.human_distance(F.col("span")).alias("words"))


ORDINAL_SQL = """CAST({0} AS VARCHAR) || CASE WHEN {0} % 10 = 1 AND {0} <> 11 THEN 'st' WHEN {0} % 10 = 2 AND {0} <> 12 THEN 'nd'
  WHEN {0} % 10 = 3 AND {0} <> 13 THEN 'rd' ELSE 'th' END"""


@check(sql("rev", f"SELECT id, {ORDINAL_SQL.format('day(' + day('date') + ')')} AS ordinal FROM rev"))
def fn31_ordinal(spark, folder):
    revs = adapters.order_revisions(spark, folder)
    return revs.select("id", times.ordinal(F.dayofmonth(times.to_date(F.col("date")))).alias("ordinal"))


AGE_SQL = f"""CASE WHEN span = 1 THEN 'one second old' WHEN span < 60 THEN span || ' seconds old' WHEN span < 120 THEN 'one minute old'
  WHEN span < 2700 THEN span // 60 || ' minutes old' WHEN span < 86400 THEN span // 3600 || ' hours old' WHEN span < 2419200 THEN span // 86400 || ' days old'
  WHEN span < 31536000 THEN greatest(month({day('span')}) - 1, 1) || ' months old'
  WHEN year({day('span')}) = 1971 THEN '1 year old' ELSE year({day('span')}) - 1970 || ' years old' END"""
BIRTHDAY_SQL = """(SELECT min(y) FROM (SELECT CAST(epoch(make_date({year} + k, month({d}), 1)) AS BIGINT) + (day({d}) - 1) * 86400 + {born} % 86400 AS y
  FROM (VALUES (0), (1)) v(k)) WHERE y >= {now})"""


@check(
    sql(
        "rev ev",
        f"""WITH {_SPANS} SELECT repo, id, {AGE_SQL} AS age,
  {BIRTHDAY_SQL.format(year=2001, d=day('span'), born='span', now=ORDERS_AS_OF)} AS birthday FROM sp""",
    )
)
def fn32_age_and_birthday(spark, folder):
    spans = _spans(spark, folder)
    return spans.select(
        "repo", "id", times.age_phrase(F.col("span")).alias("age"), times.next_birthday(F.col("span"), ORDERS_AS_OF).alias("birthday")
    )


@check(sql("ev", "SELECT id, date + CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * ((seq % 12) * 3600 + (seq % 4) * 900) AS shifted FROM ev"))
def fn33_local_epoch(spark, folder):
    revs = adapters.events_log(spark, folder).revisions
    sign = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).cast("long")
    shifted = times.local_epoch(F.col("date"), sign, F.col("seq") % 12, F.col("seq") % 4 * 15)
    return revs.select("id", shifted.alias("shifted"))
