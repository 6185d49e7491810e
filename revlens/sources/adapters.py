"""Change logs derived from order, event, text and page tables.

These adapters let every report run on generic business tables: an order is a
revision, its lines are the files it touched, an event is a revision without files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import times
from revlens.model import LINE, REV, STAT_COLUMNS, ChangeLog
from revlens.operators.scan import range_scan
from revlens.operators.store import seal
from revlens.sources.pieces import cut
from revlens.sources.tables import branches

def _no_parent():
    return F.lit(None).cast("string").alias("parent_id")


# Columns of the input tables; declared, so that no file is opened before a job reads it.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def order_revisions(spark: SparkSession, folder: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders as revisions; ``orders`` may be a stream in place of the table."""
    owners = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, folder, "orders") if orders is None else orders
    return orders.join(owners, "o_custkey").select(
        F.col("c_mktsegment").alias("repo"),
        F.col("o_orderstatus").alias("branch"),
        F.col("o_orderkey").cast("string").alias("id"),
        _no_parent(),
        F.col("o_orderkey").alias("seq"),
        times.epoch_of(F.col("o_orderdate")).alias("date"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("o_orderpriority").alias("message"),
    )


def order_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as file changes: returned quantities are removals, the others additions."""
    path = F.concat_ws("/", F.lower("p_type"), "p_brand", F.replace("p_name", F.lit(" "), F.lit(".")))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), path.alias("path"))
    back = F.col("l_returnflag") == "R"
    lines = F.col("l_quantity").cast("long")
    size = F.floor("l_extendedprice")
    kept = {"bytes_added": size, "lines_added": lines}
    gone = {"bytes_removed": size, "lines_removed": lines}
    sums = [F.sum(F.when(back, 0).otherwise(v)).cast("long").alias(c) for c, v in kept.items()]
    sums += [F.sum(F.when(back, v).otherwise(0)).cast("long").alias(c) for c, v in gone.items()]
    touched = table(spark, folder, "lineitem").join(parts, "l_partkey").groupBy("l_orderkey", "path").agg(*sums)
    owners = order_revisions(spark, folder).select("repo", "id", F.col("seq").alias("l_orderkey"))
    some = sum((F.col(c) for c in STAT_COLUMNS), F.lit(0)) != 0
    return touched.where(some).join(owners, "l_orderkey").select(*REV, "path", *STAT_COLUMNS)


def month_tags(revs: DataFrame) -> DataFrame:
    """First revision of each calendar month, named vYYYY.MM."""
    name = F.concat(F.lit("v"), F.date_format(times.to_date(F.col("date")), "yyyy.MM"))
    return revs.groupBy("repo", name.alias("name")).agg(F.min_by("id", F.struct("date", "seq")).alias("id"))


def orders_log(spark: SparkSession, folder: str, default: str = "F") -> ChangeLog:
    revs = order_revisions(spark, folder)
    return ChangeLog(
        revisions=revs,
        file_changes=order_changes(spark, folder),
        tags=month_tags(revs),
        branches=branches(ChangeLog(revs), default),
    )


def event_revisions(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("events").alias("repo"),
        F.lit("main").alias("branch"),
        F.col("event_id").cast("string").alias("id"),
        _no_parent(),
        F.col("event_id").alias("seq"),
        times.epoch_of(F.col("ts")).alias("date"),
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("message"),
    )


def events_log(spark: SparkSession, folder: str) -> ChangeLog:
    return ChangeLog(event_revisions(table(spark, folder, "events")))


def documents_log(spark: SparkSession, folder: str) -> ChangeLog:
    revs = table(spark, folder, "documents").select(
        F.lit("documents").alias("repo"),
        F.col("lang").alias("branch"),
        F.col("doc_id").cast("string").alias("id"),
        _no_parent(),
        F.col("doc_id").alias("seq"),
        F.lit(0).cast("long").alias("date"),
        F.col("source").alias("author"),
        F.col("text").alias("message"),
    )
    return ChangeLog(revs)


# Log positions for each conversation; a turn beyond them is an error, never a wrong order.
_TURNS = 1 << 31


def conversations_log(spark: SparkSession, folder: str) -> ChangeLog:
    """Each turn is a revision by its role and a version of its conversation's file."""
    turns = table(spark, folder, "conversations")
    id = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    revs = turns.select(
        F.lit("conversations").alias("repo"),
        F.lit("main").alias("branch"),
        id.alias("id"),
        _no_parent(),
        F.when(F.col("turn").between(0, _TURNS - 1), F.col("conv_id") * _TURNS + F.col("turn"))
        .otherwise(F.raise_error(F.lit("a turn is out of range")).cast("long"))
        .alias("seq"),
        F.lit(0).cast("long").alias("date"),
        F.col("role").alias("author"),
        F.col("text").alias("message"),
    )
    contents = turns.select(
        F.lit("conversations").alias("repo"),
        id.alias("id"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
        F.col("turn").alias("seq"),
        F.col("text").alias("content"),
    )
    return ChangeLog(revs, contents=contents)


def pages_log(spark: SparkSession, folder: str) -> ChangeLog:
    """The URL paths of all pages as the tree of one revision."""
    pages = table(spark, folder, "pages")
    path = F.ltrim(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    tree = pages.select(F.lit("pages").alias("repo"), F.lit("HEAD").alias("id"), path.alias("path"))
    head = pages.groupBy().agg(F.count("*").alias("n")).select(
        F.lit("pages").alias("repo"), F.lit("main").alias("branch"), F.lit("HEAD").alias("head_id"), F.lit(True).alias("is_default")
    )
    return ChangeLog(head.select(*LINE, F.col("head_id").alias("id")), tree=tree, branches=head)


def order_dag(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each customer as a branch: parent = the customer's previous order, head = the last one."""
    revs = order_revisions(spark, folder).withColumn("branch", F.col("author"))
    before = ("max", F.struct("date", "seq", "id"))
    linked = range_scan(revs.select(*LINE, "date", "seq", "id"), LINE, ["date", "seq"], {"before": before}, exclusive=True)
    dag = linked.select("repo", "id", F.col("before.id").alias("parent_id"))
    heads = revs.groupBy(*LINE).agg(F.max_by("id", F.struct("date", "seq")).alias("head_id"))
    return dag, heads


def order_intervals(spark: SparkSession, folder: str) -> DataFrame:
    revs = order_revisions(spark, folder)
    width = F.pmod(F.col("author").cast("long"), F.lit(40))
    return revs.select("repo", F.col("seq").alias("start"), (F.col("seq") + width).alias("end"))


def event_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Sealed store rows of which every 97th has a damaged checksum."""
    revs = events_log(spark, folder).revisions
    payload = F.concat_ws(":", "id", F.col("date").cast("string"), "author", "message")
    sealed = seal(revs.select("repo", "id", "seq", payload.alias("payload")))
    return sealed.withColumn("crc", F.col("crc") + F.when(F.col("seq") % 97 == 0, 1).otherwise(0))


def _prefixed(text, mark: str):
    return F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))


def _line_count(text):
    return F.size(F.split(text, "\n", -1)).cast("string")


def document_patches(spark: SparkSession, folder: str, documents: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each document as the diff that adds it; ``documents`` may be a stream. ``keep`` names further columns."""
    docs = table(spark, folder, "documents") if documents is None else documents
    head = F.concat(
        F.lit("--- /dev/null\n+++ b/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
        F.lit(".txt\n@@ -0,0 +1,"), _line_count(F.col("text")), F.lit(" @@\n"),
    )
    return docs.select(
        F.lit("documents").alias("repo"),
        F.col("doc_id").cast("string").alias("id"),
        F.concat(head, _prefixed(F.col("text"), "+")).alias("diff"),
        *(keep or []),
    )


def language_patches(spark: SparkSession, folder: str, size: int = 1024, documents: DataFrame | None = None) -> DataFrame:
    """The patches of all documents of a language as one diff, in pieces of ``size`` bytes: a few revisions hold everything."""
    own = cut(document_patches(spark, folder, documents, ["lang"]), size, ["lang"])
    piece = F.shiftleft(F.col("id").cast("long"), 20) + F.col("piece")
    return own.select("repo", F.col("lang").alias("id"), piece.alias("piece"), "diff")


def turn_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Each later turn of a conversation as the diff that replaces the turn before it."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    pairs = turns.join(before, ["conv_id", "turn"])
    name = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    diff = F.concat(
        F.lit("--- a/"), name, F.lit("\n+++ b/"), name,
        F.lit("\n@@ -1,"), _line_count(F.col("old")), F.lit(" +1,"), _line_count(F.col("text")), F.lit(" @@\n"),
        _prefixed(F.col("old"), "-"), _prefixed(F.col("text"), "+"),
    )
    id = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return pairs.select(F.lit("conversations").alias("repo"), id.alias("id"), diff.alias("diff"))


def event_git_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw git commit headers, in three time zones."""
    revs = events_log(spark, folder).revisions
    zone = F.get(F.array(F.lit("+0000"), F.lit("+0530"), F.lit("-0330")), F.pmod(F.col("seq"), F.lit(3)).cast("int"))
    who = F.concat(F.lit("User "), "author", F.lit(" <u"), "author", F.lit("@x> "), F.col("date").cast("string"), F.lit(" "))
    header = F.concat(
        "id", F.lit("\ntree t"), "id",
        F.when(F.col("seq") > 0, F.concat(F.lit("\nparent "), (F.col("seq") - 1).cast("string"))).otherwise(""),
        F.lit("\nauthor "), who, F.lit("+0000"), F.lit("\ncommitter "), who, zone,
        F.lit("\n\n    "), "message", F.lit("\n    \n    by "), "author",
    )
    return revs.select("repo", "id", header.alias("header"))


def event_hg_headers(spark: SparkSession, folder: str) -> DataFrame:
    revs = events_log(spark, folder).revisions
    west = F.pmod(F.col("seq"), F.lit(5)) * 3600 - 7200
    header = F.concat(
        F.col("date").cast("string"), F.lit(" "), west.cast("string"), F.lit("\n"), "author", F.lit("\n"), "message", F.lit("\nby "), "author"
    )
    return revs.select("repo", "id", header.alias("header"))


def event_svn_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events as revision properties; errors have no author and purchases no log."""
    stamps = table(spark, folder, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    type = F.col("event_type")
    pairs = F.map_from_arrays(
        F.array(F.lit("svn:author"), F.lit("svn:date"), F.lit("svn:log")),
        F.array(F.col("user_id").cast("string"), stamp, type),
    )
    props = F.map_filter(
        pairs,
        lambda k, v: ~(((type == "error") & (k == "svn:author")) | ((type == "purchase") & (k == "svn:log"))),
    )
    return stamps.select(F.lit("events").alias("repo"), F.col("event_id").cast("string").alias("id"), props.alias("props"))
