"""Change logs stored as Parquet tables, and the listings derived from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.model import LINE, REV, SCHEMAS, ChangeLog
from revlens.operators.scan import by_position, scan
from revlens.operators.store import exists
from revlens.operators.totals import change_bucket, change_month, net_lines


def load_changelog(spark: SparkSession, folder: str) -> ChangeLog:
    """Read the tables of a stored change log; schemas are fixed, nothing is inferred."""
    frames = {}
    for name, schema in SCHEMAS.items():
        path = os.path.join(folder, name)
        if exists(spark, path):
            frames[name] = spark.read.schema(schema).parquet(path)
    layout = os.path.join(folder, "layout")
    if not exists(spark, layout):
        return ChangeLog(**frames)
    placed = spark.read.schema(T.StructType([*SCHEMAS["file_changes"], *_PLACE])).parquet(os.path.join(folder, "file_changes"))
    frames["file_changes"] = placed.drop("month", "bucket")
    return ChangeLog(**frames, placed_changes=placed, buckets=spark.read.schema("buckets int").parquet(layout).first()["buckets"])


_PLACE = [T.StructField("month", T.LongType()), T.StructField("bucket", T.IntegerType())]


def save_changelog(log: ChangeLog, folder: str, buckets: int = 0) -> None:
    """Write a change log as Parquet tables with the declared schemas.

    With ``buckets`` file_changes lies in folders by its revision's month and that many buckets of a hash of its
    revision, so that a report on a period, or on few revisions, reads these alone. Choose them for some hundred MB
    of changes in a month's bucket. A folder that holds much is written by several tasks.
    """
    for name, schema in SCHEMAS.items():
        frame = getattr(log, name)
        if frame is None:
            continue
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
        frame, path = frame.select(*columns), os.path.join(folder, name)
        if buckets and name == "file_changes":
            dates = log.revisions.groupBy(*REV).agg(F.min("date").alias("date"))
            dated = frame.join(dates, REV, "left").withColumns({"month": change_month(F.col("date")), "bucket": change_bucket(buckets)})
            placed = dated.drop("date").hint("rebalance", "month", "bucket")
            placed.sortWithinPartitions("month", "bucket").write.mode("errorifexists").partitionBy("month", "bucket").parquet(path)
            spark = frame.sparkSession
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.mode("errorifexists").parquet(os.path.join(folder, "layout"))
        else:
            frame.write.mode("errorifexists").parquet(path)


def heads(log: ChangeLog) -> DataFrame:
    """Newest revision of every branch by (date, log position)."""
    return log.revisions.groupBy(*LINE).agg(F.max_by("id", F.struct("date", "seq")).alias("head_id"))


def branches(log: ChangeLog, default: str) -> DataFrame:
    """Branch list with head revision and default marker."""
    return heads(log).withColumn("is_default", F.col("branch") == default)


def branch_heads(log: ChangeLog) -> DataFrame:
    """Head revision rows of the listed branches."""
    listed = log.need("branches").select(*LINE, F.col("head_id").alias("id"), "is_default")
    return log.revisions.join(listed, LINE + ["id"])


def tags(log: ChangeLog) -> DataFrame:
    """Tag list sorted by name."""
    return log.need("tags").select("repo", "name", "id").orderBy("name", "repo")


def tree(log: ChangeLog, id: str | None = None) -> DataFrame:
    """Paths at a revision, or at the head of each repository's default branch."""
    listing = log.need("tree")
    if id is not None:
        return listing.where(F.col("id") == id)
    head = log.need("branches").where("is_default").select("repo", F.col("head_id").alias("id"))
    return listing.join(head, REV, "left_semi")


def tree_from_changes(log: ChangeLog, branch: str | None = None, upto: int | None = None) -> DataFrame:
    """Paths alive at a log position, from the changes alone: added lines outweigh removed ones.

    Files without lines cannot be seen this way.
    """
    revs = log.revisions if branch is None else log.revisions.where(F.col("branch") == branch)
    if upto is not None:
        revs = revs.where(F.col("seq") <= upto)
    touched = log.need("file_changes").join(revs.select(*LINE, "id"), REV)
    alive = touched.groupBy(*LINE, "path").agg(F.sum(net_lines()).alias("lines"))
    return alive.where(F.col("lines") > 0)


def cat(log: ChangeLog, requests: DataFrame) -> DataFrame:
    """Content for a batch of (repo, path, seq) requests: the latest version at or before seq.

    A null ``seq`` asks for the newest version. Versions and requests are merged in
    log order and only positions travel; the content joins in last, by exact
    position, so that no version is paired with a request it does not answer.
    """
    spot = ["repo", "path"]
    versions = log.need("contents")
    # exact duplicates of a request get the same answer
    asked = requests.where("seq is not null")
    marks = versions.select(*spot, F.col("seq").alias("at"), F.lit(0).alias("kind"), F.col("seq").alias("version"))
    probes = asked.select(*spot, F.col("seq").alias("at")).distinct().select(
        *spot, "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("version")
    )
    line = scan(marks.unionByName(probes), spot, ["at", "kind"], {"version": ("max", F.col("version"))}, by_position("at"))
    found = line.where("kind = 1 and version is not null").select(*spot, F.col("at").alias("seq"), "version")
    newest = versions.groupBy(*spot).agg(F.max("seq").alias("version"))
    heads = requests.where("seq is null").join(newest, spot).select(*spot, "seq", "version")
    answered = asked.select(*spot, "seq").join(found, spot + ["seq"]).unionByName(heads)
    body = versions.select(*spot, F.col("seq").alias("version"), "id", "content")
    return answered.join(body, spot + ["version"]).select(*spot, "seq", "version", "id", "content")
