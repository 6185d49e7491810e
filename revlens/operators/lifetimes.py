"""Trees at many positions of a log, from the times in which each path is alive.

A path is alive while the lines added to it outweigh those removed. One running sum over its changes gives the
positions where that turns, hence the ranges of positions in which it is there. A tree at a position is then the set
of paths with a range that holds it, for as many positions as are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import paths
from revlens.model import LINE, REV, ChangeLog
from revlens.operators.requests import points_inside
from revlens.operators.scan import by_position, scan
from revlens.operators.totals import net_lines
from revlens.session import written

PATH = [*LINE, "path"]


def turns(log: ChangeLog) -> DataFrame:
    """(repo, branch, path, seq, alive): the revisions at which a path comes to life, or ends."""
    revs = log.revisions.select(*LINE, *[c for c in REV if c not in LINE], "seq")
    net = log.need("file_changes").join(revs, REV).groupBy(*PATH, "seq").agg(F.sum(net_lines()).alias("net"))
    running = scan(net, PATH, ["seq"], {"lines": ("sum", F.col("net"))}, by_position("seq"))
    alive, before = F.col("lines") > 0, F.col("lines") - F.col("net") > 0
    return running.where(alive != before).select(*PATH, "seq", alive.alias("alive"))


def lifetimes(log: ChangeLog) -> DataFrame:
    """(repo, branch, path, born, dead): it is alive from revision ``born`` on and no more at ``dead``, null if it still is."""
    found = written(turns(log), "turns").withColumn("back", -F.col("seq"))
    ended = scan(found, PATH, ["back"], {"next": ("max", F.col("back"))}, by_position("back"), exclusive=True)
    return ended.where("alive").select(*PATH, F.col("seq").alias("born"), (-F.col("next")).alias("dead"))


def trees_at(log: ChangeLog, positions: DataFrame) -> DataFrame:
    """Rows of ``positions`` (repo, branch, at, and columns of its own) with each path that is alive there.

    Equals ``tree_from_changes`` up to each position, in one pass for all. Files without lines cannot be seen.
    """
    own = lifetimes(log).select(*PATH, F.col("born").alias("_born"), F.coalesce(F.col("dead") - 1, F.lit(2**62)).alias("_last"))
    return points_inside(positions, "at", own, "_born", "_last", LINE).drop("_born", "_last")


def tag_positions(log: ChangeLog) -> DataFrame:
    """(repo, branch, at, name): where the tags stand in the log; a revision on several branches has a row for each."""
    revs = log.revisions.select(*LINE, *[c for c in REV if c not in LINE], F.col("seq").alias("at"))
    return revs.join(log.need("tags").select("repo", "id", "name"), REV).select(*LINE, "at", "name")


def languages_at(log: ChangeLog, positions: DataFrame) -> DataFrame:
    """Files of each language at each position (repo, branch, at): columns language and n, only where there are some.

    Births less deaths so far, by language; no tree is listed.
    """
    moves = turns(log).withColumn("language", paths.language(F.col("path")))
    moves = moves.groupBy(*LINE, "language", F.col("seq").alias("at")).agg(F.sum(F.when(F.col("alive"), 1).otherwise(-1)).alias("move"))
    moves = written(moves, "language-moves")
    named = moves.select(*LINE, "language").distinct()
    probes = positions.select(*LINE, "at").distinct().join(named, LINE).withColumn("ask", F.lit(1))
    line = scan(moves.withColumn("ask", F.lit(0)).unionByName(probes, allowMissingColumns=True), [*LINE, "language"], ["at", "ask"], {"n": ("sum", F.coalesce("move", F.lit(0)))}, by_position("at"))
    counted = line.where("ask = 1 and n > 0").select(*LINE, "at", "language", "n")
    return positions.join(counted, [*LINE, "at"])
