"""Table schemas and the bundle of DataFrames every report works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A history line is identified by repository and branch: one ChangeLog holds any
# number of repositories, and every report answers for all of them at once.
LINE = ["repo", "branch"]
# A revision is identified by repository and id.
REV = ["repo", "id"]
STAT_COLUMNS = ["bytes_added", "lines_added", "bytes_removed", "lines_removed"]

UNKNOWN_DATE = 0
UNKNOWN_AUTHOR = ""


def _schema(strings: str, longs: str = "", bools: str = "") -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings.split()]
    fields += [T.StructField(n, T.LongType()) for n in longs.split()]
    fields += [T.StructField(n, T.BooleanType()) for n in bools.split()]
    return T.StructType(fields)


SCHEMAS = {
    "revisions": _schema("repo branch id parent_id author message", "seq date"),
    "file_changes": _schema("repo id path", " ".join(STAT_COLUMNS)),
    "tags": _schema("repo name id"),
    "branches": _schema("repo branch head_id", bools="is_default"),
    "tree": _schema("repo id path"),
    "contents": _schema("repo id path content", "seq"),
}


@dataclass(frozen=True)
class ChangeLog:
    """Lazy DataFrames of one or many repositories.

    ``revisions.seq`` is the log position, oldest first and unique within a
    history line. ``file_changes`` is unique on (repo, id, path) and holds no
    all-zero rows.
    """

    revisions: DataFrame
    file_changes: DataFrame | None = None
    tags: DataFrame | None = None
    branches: DataFrame | None = None
    tree: DataFrame | None = None
    contents: DataFrame | None = None
    #: file_changes once more, with the columns month and bucket of its folders, and the number of buckets.
    placed_changes: DataFrame | None = None
    buckets: int = 0

    def need(self, table: str) -> DataFrame:
        frame = getattr(self, table)
        if frame is None:
            raise ValueError(f"this change log has no {table} table")
        return frame
