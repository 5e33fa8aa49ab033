"""Point-to-point messages: sends and receives are matched in order for each pair of ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument

KEY = ["src", "dst", "group_id", "seq"]


def send(buffers: DataFrame, peer, seq: int = 0, group_id: int = 0) -> DataFrame:
    """Messages (src, dst, group_id, seq, idx, value) of every rank in buffers to its peer (a column or a rank)."""
    dst = F.lit(peer) if isinstance(peer, int) else peer
    return buffers.select(F.col("rank").alias("src"), dst.cast("int").alias("dst"), F.lit(group_id).alias("group_id"), F.lit(seq).alias("seq"), "idx", "value")


def in_order(calls: DataFrame, order: str) -> DataFrame:
    """Numbers calls (src, dst, ...) by the order of a column: the k-th send meets the k-th receive of its pair."""
    return calls.withColumn("seq", (F.row_number().over(Window.partitionBy("src", "dst", "group_id").orderBy(order)) - 1).cast("int"))


def recv(messages: DataFrame, receives: DataFrame) -> DataFrame:
    """receives: (rank, from_rank, group_id, seq). Gives (rank, from_rank, seq, idx, value).

    With a column n, the elements that a receive has room for, reading the result is an error if a message it is matched
    with has another length.
    """
    want = receives.select(F.col("from_rank").alias("src"), F.col("rank").alias("dst"), "group_id", "seq", *(["n"] if "n" in receives.columns else []))
    if "n" in receives.columns:
        lengths = messages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sent"))
        said = F.concat(F.lit("rank "), F.col("src"), F.lit(" sends "), F.coalesce("sent", F.lit(0)), F.lit(" elements to rank "), F.col("dst"), F.lit(", which has room for "), F.col("n"))
        met = want.join(lengths, KEY, "left")
        fits = F.coalesce("sent", F.lit(0)) == F.col("n")
        want = met.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).select(*KEY)
    met = messages.join(want, KEY)
    return met.select(F.col("dst").alias("rank"), F.col("src").alias("from_rank"), "seq", "idx", "value")


def unmatched(messages: DataFrame, receives: DataFrame) -> DataFrame:
    """(src, dst, group_id, seq, side) of sends without a receive and receives without a send."""
    sent = messages.select(*KEY).distinct()
    want = receives.select(F.col("from_rank").alias("src"), F.col("rank").alias("dst"), "group_id", "seq").distinct()
    return sent.join(want, KEY, "left_anti").withColumn("side", F.lit("send")).unionByName(want.join(sent, KEY, "left_anti").withColumn("side", F.lit("recv")))


class Group:
    """Collects sends and receives; the end of the block makes one plan of them."""

    def __init__(self):
        self._sends: list[DataFrame] = []
        self._receives: list[DataFrame] = []
        self.result: DataFrame | None = None
        self._open = False

    def __enter__(self) -> Group:
        self._open = True
        return self

    def _check(self) -> None:
        if not self._open:
            raise InvalidArgument("the group is not open")

    def send(self, messages: DataFrame) -> None:
        self._check()
        self._sends.append(messages)

    def recv(self, receives: DataFrame) -> None:
        self._check()
        self._receives.append(receives)

    def __exit__(self, kind, *_) -> None:
        self._open = False
        if kind is not None or not (self._sends or self._receives):
            return
        if not self._sends or not self._receives:
            raise InvalidArgument("a group needs sends and receives")
        self.result = recv(reduce(DataFrame.unionByName, self._sends), reduce(DataFrame.unionByName, self._receives))
