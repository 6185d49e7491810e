"""Scans, sources, sinks and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import day, registry, slot_sql, sql
from revlens.model import LINE
from revlens.operators import lifetimes
from revlens.operators import select as sel
from revlens.operators import totals
from revlens.plans import reports
from revlens.session import scratch_path
from revlens.sinks import dumps
from revlens.sources import adapters, diffs, headers, pieces, rawlogs, tables
from revlens.streaming import feeds

ENTRIES, check = registry()

NL = "chr(10)"


@check(sql("fc", "SELECT * FROM fc"))
def src1_load_changelog(spark, folder):
    path = scratch_path(spark, "changelog")
    tables.save_changelog(adapters.orders_log(spark, folder), path)
    return tables.load_changelog(spark, path).file_changes


@check(
    sql(
        "tot",
        """SELECT repo, branch, slot, CAST(count(*) AS BIGINT) AS commits, CAST(sum(files) AS BIGINT) AS changes
FROM (SELECT *, """ + slot_sql(day("date"), "days") + """ AS slot FROM tot WHERE date >= 915148800 AND date < 917827200) GROUP BY 1, 2, 3""",
    )
)
def flt1_month_of_placed_changes(spark, folder):
    """January 1999 of a log stored by month and bucket: the changes of other months are not read."""
    path = scratch_path(spark, "placed")
    tables.save_changelog(adapters.orders_log(spark, folder), path, buckets=4)
    log = tables.load_changelog(spark, path)
    month = sel.revisions(log, start=915148800, stop=917827199)
    return totals.slot_counts(totals.selected_totals(log, month), "days")


@check(
    sql(
        "ev",
        f"""SELECT repo, id, 'User ' || author AS author,
  date + CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 19800 ELSE -12600 END AS date,
  message || {NL} || {NL} || 'by ' || author || {NL} AS message FROM ev""",
    )
)
def src2_git_headers(spark, folder):
    return headers.parse_git_headers(adapters.event_git_headers(spark, folder))


@check(
    sql(
        "ev",
        f"""SELECT repo, id, author, date - (seq % 5 * 3600 - 7200) AS date,
  message || {NL} || 'by ' || author AS message FROM ev""",
    )
)
def src3_hg_log(spark, folder):
    return headers.parse_hg_log(adapters.event_hg_headers(spark, folder))


@check(
    sql(
        "ev",
        """SELECT repo, id, CASE WHEN message = 'error' THEN '' ELSE author END AS author, date,
  CASE WHEN message = 'purchase' THEN '' ELSE message END AS message FROM ev""",
    )
)
def src4_svn_props(spark, folder):
    return headers.parse_svn_props(adapters.event_svn_props(spark, folder))


@check(ENTRIES["src2_git_headers"].sql)
def src2_raw_log_files(spark, folder):
    """The headers as files of many records."""
    path = scratch_path(spark, "git-log")
    adapters.event_git_headers(spark, folder).select("header").write.option("lineSep", rawlogs.END).text(path)
    return rawlogs.git_log(spark, path, "events")


@check(ENTRIES["src3_hg_log"].sql)
def src3_raw_log_files(spark, folder):
    path = scratch_path(spark, "hg-log")
    own = adapters.event_hg_headers(spark, folder)
    own.select(F.concat("id", F.lit("\n"), "header").alias("value")).write.option("lineSep", rawlogs.END).text(path)
    return rawlogs.hg_log(spark, path, "events")


@check(ENTRIES["src2_git_headers"].sql)
def str1_raw_log_feed(spark, folder):
    """The same files as a stream."""
    path = scratch_path(spark, "git-feed")
    adapters.event_git_headers(spark, folder).select("header").write.option("lineSep", rawlogs.END).text(path)
    return feeds.append_to(rawlogs.git_log(spark, path, "events", stream=True), scratch_path(spark, "git-rows"))


@check(
    f"""SELECT 'documents' AS repo, CAST(doc_id AS VARCHAR) AS id,
  'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  CAST(strlen(text) + 1 AS BIGINT) AS bytes_added, CAST(len(string_split(text, {NL})) AS BIGINT) AS lines_added,
  CAST(0 AS BIGINT) AS bytes_removed, CAST(0 AS BIGINT) AS lines_removed FROM documents"""
)
def src5_document_diffs(spark, folder):
    return diffs.diffstat_from_diffs(adapters.document_patches(spark, folder))


@check(
    f"""SELECT 'conversations' AS repo, CAST(n.conv_id AS VARCHAR) || '.' || CAST(n.turn AS VARCHAR) AS id,
  'conv/' || CAST(n.conv_id AS VARCHAR) AS path,
  CAST(strlen(n.text) + 1 AS BIGINT) AS bytes_added, CAST(len(string_split(n.text, {NL})) AS BIGINT) AS lines_added,
  CAST(strlen(o.text) + 1 AS BIGINT) AS bytes_removed, CAST(len(string_split(o.text, {NL})) AS BIGINT) AS lines_removed
FROM conversations n JOIN conversations o ON o.conv_id = n.conv_id AND o.turn + 1 = n.turn"""
)
def src5_turn_diffs(spark, folder):
    return diffs.diffstat_from_diffs(adapters.turn_patches(spark, folder))


@check(
    f"""SELECT 'documents' AS repo, lang AS id, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  CAST(strlen(text) + 1 AS BIGINT) AS bytes_added, CAST(len(string_split(text, {NL})) AS BIGINT) AS lines_added,
  CAST(0 AS BIGINT) AS bytes_removed, CAST(0 AS BIGINT) AS lines_removed FROM documents"""
)
def src5_pieced_diffs(spark, folder):
    """All documents of a language as one diff, cut into pieces of a kilobyte."""
    return pieces.diffstat_from_pieces(adapters.language_patches(spark, folder))


@check(sql("tree", "SELECT repo, id, path FROM tree"))
def src6_tree(spark, folder):
    return tables.tree(adapters.pages_log(spark, folder))


@check(
    sql(
        "fc",
        """SELECT rev.repo, branch, path, CAST(sum(lines_added - lines_removed) AS BIGINT) AS lines
FROM fc JOIN rev USING (repo, id) GROUP BY 1, 2, 3 HAVING sum(lines_added - lines_removed) > 0""",
    )
)
def src7_tree_from_changes(spark, folder):
    return tables.tree_from_changes(adapters.orders_log(spark, folder))


#: Paths alive at each tag, one row for each.
AT_TAGS = """tp AS (SELECT rev.repo, branch, seq AS "at", name FROM tags JOIN rev USING (repo, id)),
net AS (SELECT rev.repo, branch, path, seq, lines_added - lines_removed AS d FROM fc JOIN rev USING (repo, id)),
alive AS (SELECT repo, branch, "at", name, path FROM tp JOIN net USING (repo, branch) WHERE seq <= "at" GROUP BY ALL HAVING sum(d) > 0)"""


@check(
    sql(
        "fc tags",
        f"""WITH {AT_TAGS} SELECT repo, branch, "at", name, count(*) AS files, CAST(sum(length(path)) AS BIGINT) AS letters, min(path) AS first, max(path) AS last
FROM alive GROUP BY 1, 2, 3, 4""",
    )
)
def src7_trees_at_tags(spark, folder):
    """The trees at all tags, summed up."""
    log = adapters.orders_log(spark, folder)
    trees = lifetimes.trees_at(log, lifetimes.tag_positions(log))
    sums = [F.count("*").alias("files"), F.sum(F.length("path")).alias("letters"), F.min("path").alias("first"), F.max("path").alias("last")]
    return trees.groupBy(*LINE, "at", "name").agg(*sums)


@check(
    """WITH req AS (
  SELECT conv_id, turn * 2 AS asked FROM conversations
  UNION SELECT conv_id, -1 FROM conversations),
hit AS (
  SELECT conv_id, asked, max(turn) AS version FROM req JOIN conversations USING (conv_id)
  WHERE asked = -1 OR turn <= asked GROUP BY 1, 2)
SELECT 'conversations' AS repo, 'conv/' || CAST(conv_id AS VARCHAR) AS path, asked, version,
  CAST(conv_id AS VARCHAR) || '.' || CAST(version AS VARCHAR) AS id, text AS content
FROM hit JOIN conversations c USING (conv_id) WHERE c.turn = version"""
)
def src8_cat(spark, folder):
    log = adapters.conversations_log(spark, folder)
    spots = log.contents.select("repo", "path", (F.col("seq") * 2).alias("seq"))
    newest = log.contents.select("repo", "path", F.lit(None).cast("long").alias("seq")).distinct()
    found = tables.cat(log, spots.unionByName(newest))
    return found.select("repo", "path", F.coalesce("seq", F.lit(-1)).alias("asked"), "version", "id", "content")


@check(sql("br", "SELECT * FROM br"))
def src9_branches(spark, folder):
    return adapters.orders_log(spark, folder).branches


@check(sql("tags", "SELECT * FROM tags"))
def src10_tags(spark, folder):
    return tables.tags(adapters.orders_log(spark, folder))


ALL_COLUMNS = "id,a,+,-,d,t,f,m"
_ROWS = """WITH row AS (
  SELECT repo, branch, seq, date, id, author, message, lines_added AS la, lines_removed AS lr,
    CAST(sum(lines_added - lines_removed) OVER (PARTITION BY repo, branch ORDER BY seq) AS BIGINT) AS total,
    coalesce(paths, []) AS paths
  FROM tot LEFT JOIN (SELECT repo, id, list(path ORDER BY path) AS paths FROM fc GROUP BY 1, 2) f USING (repo, id))"""
_ESC = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"""
_LEGACY = r"""'"' || replace(replace(replace(replace({0}, ',', '\,'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '"'"""


def _esc(column):
    return _ESC.format(column)


def _csv(column):
    return f"""'"' || replace({_esc(column)}, ',', '\\,') || '"'"""


def _json(column):
    return f"""'"' || {_esc(column)} || '"'"""


@check(
    sql(
        "tot",
        f"""{_ROWS} SELECT repo, branch, seq, concat_ws(',', date, id, author, la, lr, la - lr, total,
  array_to_string(paths, ':'), {_LEGACY.format('message')}) AS line FROM row""",
    )
)
def snk1_csv_legacy(spark, folder):
    return dumps.dump_csv_legacy(adapters.orders_log(spark, folder), ALL_COLUMNS)


@check(sql("docs", f"SELECT repo, branch, seq, concat_ws(',', date, id, author, {_LEGACY.format('message')}) AS line FROM docs"))
def snk1_csv_legacy_texts(spark, folder):
    return dumps.dump_csv_legacy(adapters.documents_log(spark, folder), "id,author,message")


@check(
    sql(
        "tot",
        f"""{_ROWS} SELECT repo, branch, seq, concat_ws(',', date, {_csv('id')}, {_csv('author')}, la, lr, la - lr, total,
  {_csv("array_to_string(paths, ':')")}, {_csv('message')}) AS line FROM row""",
    )
)
def snk2_csv(spark, folder):
    return dumps.dump_csv(adapters.orders_log(spark, folder), ALL_COLUMNS)


@check(sql("docs", f"SELECT repo, branch, seq, concat_ws(',', date, {_csv('id')}, {_csv('author')}, {_csv('message')}) AS line FROM docs"))
def snk2_csv_texts(spark, folder):
    return dumps.dump_csv(adapters.documents_log(spark, folder), "id,a,m")


@check(
    sql(
        "tot",
        f"""{_ROWS} SELECT repo, branch, seq, '[' || concat_ws(',', date, {_json('id')}, {_json('author')}, la, lr, la - lr, total,
  '[' || array_to_string(list_transform(paths, lambda p: {_json('p')}), ',') || ']', {_json('message')}) || ']' AS line FROM row""",
    )
)
def snk3_json(spark, folder):
    return dumps.dump_json(adapters.orders_log(spark, folder), ALL_COLUMNS)


@check(sql("docs", f"SELECT repo, branch, seq, '[' || concat_ws(',', date, {_json('id')}, {_json('author')}, {_json('message')}) || ']' AS line FROM docs"))
def snk3_json_texts(spark, folder):
    return dumps.dump_json(adapters.documents_log(spark, folder), "id,a,m")


REVDUMP_SQL = sql(
    "fc",
    f"""SELECT repo, branch, id, seq, CAST(0 AS INTEGER) AS section, '' AS path,
  array_to_string(['-- Revision', id, '-- Date', CAST(date AS VARCHAR), '-- Author', author, '-- Message ', message, '-- Diffstat'], {NL}) AS line
FROM rev
UNION ALL SELECT repo, branch, id, seq, 2, '', repeat('=', 66) FROM rev
UNION ALL SELECT rev.repo, branch, id, seq, 1, path,
  path || ' +' || lines_added || ' -' || lines_removed || ' +' || bytes_added || ' -' || bytes_removed FROM rev JOIN fc USING (repo, id)""",
)


@check(REVDUMP_SQL)
def snk4_revision_dump(spark, folder):
    return dumps.revision_dump(adapters.orders_log(spark, folder))


@check(
    sql(
        "tot",
        f"""WITH s AS (
  SELECT repo, branch, {slot_sql(day('date'), 'months')} AS slot, count(*) AS commits, sum(files) AS changes FROM tot GROUP BY 1, 2, 3)
SELECT repo, branch, 'commits' AS series, CAST(slot AS DOUBLE) AS x, CAST(commits AS DOUBLE) AS y FROM s
UNION ALL SELECT repo, branch, 'changes', CAST(slot AS DOUBLE), CAST(changes AS DOUBLE) FROM s""",
    )
)
def snk5_series(spark, folder):
    log = adapters.orders_log(spark, folder)
    counts = totals.slot_counts(totals.revision_totals(log.revisions, log.file_changes), "months")
    return dumps.to_series(counts, "slot", ["commits", "changes"], LINE)


_REVISION = "repo, branch, id, seq, date, author, message"


def _shown(revs):
    return revs.select(*LINE, "id", "seq", "date", "author", "message")


@check(sql("rev", f"SELECT {_REVISION} FROM rev WHERE branch = 'F' AND date BETWEEN 820454400 AND 946684800"))
def flt1_revisions(spark, folder):
    log = adapters.orders_log(spark, folder)
    return _shown(sel.revisions(log, sel.DEFAULT_BRANCH, 820454400, 946684800, in_order=True))


@check(sql("rev", f"SELECT {_REVISION} FROM rev WHERE id = '100'"))
def flt3_revision(spark, folder):
    return _shown(sel.revision(adapters.orders_log(spark, folder), "100"))


@check(sql("fc", "SELECT * FROM fc WHERE starts_with(path, 'promo/Brand#1')"))
def flt4_prefix(spark, folder):
    return sel.filter_prefix(adapters.order_changes(spark, folder), "promo/Brand#1")


@check(sql("rev", f"SELECT {_REVISION} FROM rev WHERE author = '7'"))
def flt5_author(spark, folder):
    return _shown(sel.by_author(adapters.order_revisions(spark, folder), "7"))


@check(sql("ev docs", f"SELECT {_REVISION} FROM ev UNION ALL SELECT {_REVISION} FROM docs WHERE date <> 0"))
def flt6_dated_and_attributed(spark, folder):
    revs = adapters.events_log(spark, folder).revisions.unionByName(adapters.documents_log(spark, folder).revisions)
    return _shown(sel.attributed(sel.dated(revs)))


@check(sql("tags", "SELECT * FROM tags WHERE regexp_matches(name, '199[68]\\.0')"))
def flt7_tags(spark, folder):
    return sel.filter_tags(adapters.orders_log(spark, folder).tags, r"199[68]\.0")


@check(
    sql(
        "tot",
        """SELECT repo, branch, seq, date, id AS c_id, author AS c_author, lines_added AS c_added, lines_removed AS c_removed,
  lines_added - lines_removed AS c_delta,
  CAST(sum(lines_added - lines_removed) OVER (PARTITION BY repo, branch ORDER BY seq) AS BIGINT) AS c_total, message AS c_message FROM tot""",
    )
)
def flt8_columns(spark, folder):
    return dumps.select_columns(adapters.orders_log(spark, folder), "id,a,+,-,d,t,m")


@check(
    sql(
        "tot",
        """SELECT * FROM (SELECT repo, branch, date, CAST(sum(sum(lines_added - lines_removed)) OVER (PARTITION BY repo, branch ORDER BY date) AS BIGINT) AS loc
FROM tot WHERE date <> 0 AND date <= 978307200 GROUP BY 1, 2, 3) WHERE date >= 883612800""",
    )
)
def flt9_clip_after_total(spark, folder):
    return reports.loc(adapters.orders_log(spark, folder), datemin="1998-01-01", datemax="2001-01-01")
