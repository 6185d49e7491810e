"""First-parent history by pointer doubling over runs of ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import written

# Doublings of the ancestor runs: each revision gets a run of up to 2 ** RUN ancestors.
RUN = 4


def _runs(dag: DataFrame) -> DataFrame:
    """repo, id and the next ancestors, nearest first. Runs that have reached a root are joined no further."""
    up = dag.where("parent_id is not null").select("repo", "id", F.array("parent_id").alias("ups"))
    for k in range(RUN):
        up = written(up, "runs")
        full = F.size("ups") == 1 << k
        onward = up.select("repo", F.col("id").alias("last"), F.col("ups").alias("more"))
        going = up.where(full).withColumn("last", F.element_at("ups", -1)).join(onward, ["repo", "last"], "left")
        grown = going.select("repo", "id", F.when(F.col("more").isNull(), F.col("ups")).otherwise(F.concat("ups", "more")).alias("ups"))
        up = up.where(~full).unionByName(grown)
    return up


def _walk(dag: DataFrame, heads: DataFrame, once: bool) -> DataFrame:
    runs = written(_runs(dag), "runs")
    length = 1 << RUN
    jump = runs.where(F.size("ups") == length).select("repo", "id", F.element_at("ups", -1).alias("up"))
    start = heads.select("repo", "branch", F.col("head_id").alias("id"), F.lit(0).cast("long").alias("depth"))
    walk, step, most = written(start, "walk"), length, None
    while True:
        onto = walk.join(jump, ["repo", "id"])
        reached = written(onto.select("repo", "branch", F.col("up").alias("id"), (F.col("depth") + step).alias("depth")), "walk")
        if reached.isEmpty():
            break
        most = most or runs.count()
        if step > most:
            raise ValueError("the parent links run in a circle")
        walk = walk.unionByName(reached)
        if once:
            walk = written(_first_head(walk), "walk")
        onward = jump.select("repo", F.col("id").alias("up"), F.col("up").alias("top"))
        jump = written(jump.join(onward, ["repo", "up"]).select("repo", "id", F.col("top").alias("up")), "jump")
        step *= 2
    inside = walk.join(runs, ["repo", "id"]).select("repo", "branch", "depth", F.posexplode("ups").alias("at", "id"))
    return start.unionByName(inside.select("repo", "branch", "id", (F.col("depth") + F.col("at") + 1).alias("depth")))


def _first_head(walk: DataFrame) -> DataFrame:
    first = walk.groupBy("repo", "id").agg(F.min(F.struct("branch", "depth")).alias("first"))
    return first.select("repo", "first.branch", "id", "first.depth")


def first_parent_chain(dag: DataFrame, heads: DataFrame, branch: str | None = None) -> DataFrame:
    """Revisions on the first-parent path of each head, or of one branch's, with their distance from it.

    ``dag`` has repo, id and parent_id (null at a root); ``heads`` has repo, branch and head_id. Each revision
    first gets a run of ancestors; the walk then doubles its stride over runs and expands them at the end, so
    that a chain of n takes about log2(n) - RUN rounds over one walked row in sixteen. Finished pointers leave
    the jump table, hence no null key ever piles up. Each round is written to the shared folder: the lineage
    stays short and a lost executor costs one round. Links that run in a circle are an error.

    History that many heads share is repeated for each of them: for more than a few use ``first_parent_history``.
    """
    return _walk(dag, heads if branch is None else heads.where(F.col("branch") == branch), False)


def first_parent_history(dag: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every revision on any head's path once, and where the paths of the branches join.

    A revision is listed under the first branch by name whose path it is on, with its distance from that head.
    The second table has a row (repo, branch, onto, at) for each place where a branch's path goes on as that of
    an earlier one; a branch whose head is such a place has only that row.
    """
    history = written(_first_head(_walk(dag, heads, True)), "history")
    owner = history.select("repo", "id", F.col("branch").alias("onto"))
    up = dag.where("parent_id is not null").select("repo", "id", F.col("parent_id").alias("at"))
    steps = history.join(up, ["repo", "id"]).select("repo", "branch", "at")
    starts = heads.select("repo", "branch", F.col("head_id").alias("at"))
    joins = steps.unionByName(starts).join(owner.withColumnRenamed("id", "at"), ["repo", "at"]).where("branch <> onto")
    return history, joins.select("repo", "branch", "onto", "at")
