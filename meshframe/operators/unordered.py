"""Calls that ranks issue in different orders, as tables: which call of one rank is which of another, and in what order
all of them run.

The k-th call that a rank issues under a match_id meets the k-th of every other rank. Calls that all ranks have issued run
in rank 0's order; the others wait, and the ranks that they wait for are listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.operators.comm import Communicator
from meshframe.sources.buffers import positions


def occurrences(calls: DataFrame) -> DataFrame:
    """calls (rank, match_id, at) with the occurrence of the match_id in its rank, from 0."""
    return calls.withColumn("occurrence", F.row_number().over(Window.partitionBy("rank", "match_id").orderBy("at")) - 1)


def agreed(calls: DataFrame, comm: Communicator) -> DataFrame:
    """(match_id, occurrence, position, missing): the place of each call in the common order, dense from 0, or null and the
    ranks that have not issued it."""
    met = occurrences(calls).groupBy("match_id", "occurrence").agg(F.collect_set("rank").alias("ranks"), F.min(F.when(F.col("rank") == 0, F.col("at"))).alias("lead"))
    met = met.withColumn("missing", F.array_sort(F.array_except(comm.ranks(), "ranks"))).drop("ranks")
    whole = positions(met.where(F.size("missing") == 0), [], "lead", name="position")
    waiting = met.where(F.size("missing") > 0).withColumn("position", F.lit(None).cast("bigint"))
    columns = ["match_id", "occurrence", "position", "missing"]
    return whole.select(*columns).unionByName(waiting.select(*columns))


def schedule(calls: DataFrame, comm: Communicator) -> DataFrame:
    """(rank, match_id, occurrence, at, position) of the calls that run."""
    order = agreed(calls, comm).where("position is not null").drop("missing")
    return occurrences(calls).join(order, ["match_id", "occurrence"]).select("rank", "match_id", "occurrence", "at", "position")


def start_order(calls: DataFrame, mode: str = "direct") -> DataFrame:
    """calls (call, priority) with the place at which each starts: by priority (direct), from the last on (lifo), or as
    issued (none); equals in the order of call numbers, below 2**40."""
    key = {"none": F.col("call"), "direct": -F.col("priority").cast("bigint") * (1 << 40) + F.col("call"), "lifo": -F.col("call")}[mode]
    return positions(calls.withColumn("__key", key), [], "__key", name="place").drop("__key")


def fused(calls: DataFrame, bytes_threshold: int = 16384, count_threshold: int = 256) -> DataFrame:
    """calls (call, kind, bytes) with fused_into, the first call of its group: calls below the threshold that are of one
    kind join, so many at most; a large one is a group by itself."""
    small = positions(calls.where(F.col("bytes") < bytes_threshold), ["kind"], "call", name="place")
    small = small.withColumn("group", F.floor(F.col("place") / count_threshold))
    first = Window.partitionBy("kind", "group")  # count_threshold rows at most
    small = small.withColumn("fused_into", F.min("call").over(first)).drop("place", "group")
    return small.unionByName(calls.where(F.col("bytes") >= bytes_threshold).withColumn("fused_into", F.col("call")))
