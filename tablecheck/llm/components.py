"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tablecheck.llm.common import written

LEAST_TASKS, TASK_LINKS = 16, 100_000


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, root`` for links ``a, b``: the smallest node reachable, for all but the roots.

    Every round hangs the neighbours of a node below the smallest of them and is a table in the
    shared folder; the number of rounds grows with the logarithm of the longest path. Hubs are
    split as skewed joins, as both sides of that join are read from tables. ``known`` are the
    components of other links, to which these are added: only their roots are linked anew.
    Links should be a table, as they are read twice.
    """
    if known is not None:
        if links.isEmpty():
            return known
        links = _between_roots(links, known)
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.distinct(), "edges")
    # Tasks for the number of links, which never grows: a round is short stages only.
    tasks = max(LEAST_TASKS, math.ceil(edges.count() / TASK_LINKS))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("least"),
            F.count_if(F.col("v") < F.col("u")).alias("up"), F.count_if(F.col("v") > F.col("u")).alias("down"),
        )
        least = written(least.coalesce(tasks), "least")
        # Stars: a node either hangs below one other or has others below it.
        if least.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        least = least.select("u", "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct().coalesce(tasks)
        lowest = large.groupBy("u").agg(F.min("v").alias("least")).coalesce(tasks)
        hung = large.join(lowest, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = hung.union(lowest.select("u", F.col("least").alias("v"))).distinct()
        edges = written(edges.coalesce(tasks), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if known is None:
        return roots
    moved = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    below = known.join(moved, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return written(below.union(roots), "roots")


def _between_roots(links: DataFrame, known: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        root = known.select(F.col("node").alias(side), F.col("root").alias("root_of"))
        links = links.join(root, side, "left").withColumn(side, F.coalesce("root_of", side)).drop("root_of")
    return links.select("a", "b")
