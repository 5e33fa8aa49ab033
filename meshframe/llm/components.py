"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sends every node's neighbours to the smallest node it knows; both are grouped minima and equi-joins, so no
component meets in one task. The state after each round is written to the shared folder and the one before is removed.
Only two numbers a round, to see whether anything changed, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, tasks_for

#: Edges for each task.
EACH = 100_000


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(n)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(n).distinct().coalesce(n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(n)
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n)
    return near.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(n)


def connected_components(edges: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """(node, component): for edges (a, b), each node but the smallest of its component, with that smallest.

    rows: about how many edges there are. The result is the last table of scratch.
    """
    own = Scratch(edges.sparkSession)
    state = own.stash(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct().coalesce(tasks_for(edges.sparkSession, rows, EACH)), "edges")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            scratch.paths += own.paths
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        n = tasks_for(edges.sparkSession, mark[0], EACH)
        state = own.stash(_small_star(_large_star(state, n), n), "edges")
        own.remove(keep=1)
