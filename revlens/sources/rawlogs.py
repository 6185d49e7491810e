"""Raw logs as files: many records in a file, which is read by ranges of its bytes.

A record ends with a mark that cannot occur in it. Spark's text source looks for the mark from the start of its range
on and reads past the range's end to the next one, so that a log of any size is read by as many tasks as it has
ranges (spark.sql.files.maxPartitionBytes), and by whatever file system Spark reads from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources.headers import parse_git_headers, parse_hg_log

# Fixed value: what ends a record of a log that is written with one header after the other.
END = "\0"


def records(spark: SparkSession, path: str, end: str = END, stream: bool = False) -> DataFrame:
    """One row (record) for each record of the files at ``path``; as a stream, of all files that are added to it."""
    reader = spark.readStream if stream else spark.read
    texts = reader.option("lineSep", end).text(path)
    return texts.where("value <> ''").select(F.col("value").alias("record"))


def raw_headers(spark: SparkSession, path: str, repo: str, end: str = END, stream: bool = False) -> DataFrame:
    """(repo, id, header): a record's first line names its revision."""
    own = records(spark, path, end, stream)
    return own.select(F.lit(repo).alias("repo"), F.substring_index("record", "\n", 1).alias("id"), F.col("record").alias("header"))


def git_log(spark: SparkSession, path: str, repo: str, local_time: bool = True, strict: bool = False, stream: bool = False) -> DataFrame:
    """(repo, id, author, date, message) of a log of raw commit headers, each with its id before it and a zero byte after it.

    What cannot be read is left out; ``rejected_git`` of ``raw_headers`` lists it. Positions in the log are not told.
    """
    return parse_git_headers(raw_headers(spark, path, repo, stream=stream), local_time, strict)


def hg_log(spark: SparkSession, path: str, repo: str, end: str = END, stream: bool = False) -> DataFrame:
    """The same columns of a log whose records are lines of id, 'epoch offset', author, then the message."""
    own = raw_headers(spark, path, repo, end, stream)
    return parse_hg_log(own.withColumn("header", F.substr("header", F.length("id") + 2)))
