"""Collectives planned as the settings say. A strategy changes a call's plan, never its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument
from meshframe.functions.datatypes import REGISTRY
from meshframe.functions.pairwise import multiplied
from meshframe.functions.reductions import PROD, stages
from meshframe.operators import collectives as C
from meshframe.operators import p2p
from meshframe.operators.comm import Communicator
from meshframe.plans.selection import choose
from meshframe.plans.settings import Settings
from meshframe.sources.buffers import pack
from meshframe.streaming.runtime import Call, FusionLimits, OpAttr, fuse


def _strategy(collective: str, count: int, op, dtype: str, settings: Settings, packed: bool) -> str:
    """What the hints have for count elements of the type; reductions of the caller's own have one plan only."""
    chosen = choose(settings.hints(collective), count * REGISTRY[dtype].bytes, "packed" if packed else "long")
    return "packed" if packed else "long" if callable(op) or not isinstance(op, str) else chosen


def allreduce(buffers: DataFrame, comm: Communicator, count: int, op="sum", dtype: str = "float32", settings: Settings | None = None, per_node: int = 2, packed: bool = False, collective: str = "allreduce") -> C.Replicated:
    """An allreduce by the strategy that the hints have for count elements of the type.

    buffers come in long form, or in packed form (packed) with chunks of settings.chunk_elements, which only that strategy
    leaves as they are.
    """
    settings = settings or Settings()
    strategy, width = _strategy(collective, count, op, dtype, settings, packed), settings.chunk_elements
    if packed:
        return C.allreduce_packed(buffers, comm, width, op, dtype, settings.bf16)
    if strategy == "packed":
        # A rank may hold an element several times, or not at all: it is reduced in the rank, then placed.
        kind = REGISTRY[dtype]
        if op == PROD and kind.kind in ("int", "uint"):
            own = multiplied(buffers, kind, by_rank=True)
        else:
            own = buffers.groupBy("rank", "buf_id", "idx").agg(stages(op, kind)[0](F.col("value")).alias("value"))
        return C.allreduce_packed(pack(own, width), comm, width, op, dtype, settings.bf16, wide=True)
    if strategy == "tree":
        return C.allreduce_2d(buffers, comm, per_node, op, dtype, settings.bf16)
    return C.allreduce(buffers, comm, op, dtype, rounding=settings.bf16)


def reduce(buffers: DataFrame, comm: Communicator, root: int, count: int, op="sum", dtype: str = "float32", settings: Settings | None = None, per_node: int = 2) -> DataFrame:
    return allreduce(buffers, comm, count, op, dtype, settings, per_node, collective="reduce").on(root)


def reduce_scatter(buffers: DataFrame, comm: Communicator, recv_count: int, op="sum", dtype: str = "float32", settings: Settings | None = None, per_node: int = 2) -> DataFrame:
    kept = buffers.where(F.col("idx") < comm.size * recv_count)
    values = allreduce(kept, comm, comm.size * recv_count, op, dtype, settings, per_node, collective="reduce_scatter").values
    each = max(recv_count, 1)
    return values.select(F.floor(F.col("idx") / each).cast("int").alias("rank"), "buf_id", (F.col("idx") % each).alias("idx"), "value")


def call(name: str, buffers: DataFrame, comm: Communicator, attr: OpAttr | None = None, **args):
    """A collective by name with a call's attributes: reduction_fn takes the place of op, vector_buf asks for a buffer for
    each sender, group_id names a send's messages, and to_cache keeps the result for further readings."""
    attr = attr or OpAttr()
    if name not in CALLS:
        raise InvalidArgument(f"no collective {name}")
    if attr.reduction_fn is not None:
        if name not in ("allreduce", "reduce", "reduce_scatter"):
            raise InvalidArgument(f"{name} reduces nothing")
        args["op"] = attr.reduction_fn
    if name == "send":
        return p2p.send(buffers, group_id=attr.group_id, **args)
    if attr.vector_buf:
        if f"{name}_vector" not in CALLS:
            raise InvalidArgument(f"{name} has no buffers for each sender")
        name = f"{name}_vector"
    out = CALLS[name](buffers, comm, **args)
    if attr.to_cache:
        (out.values if isinstance(out, C.Replicated) else out).persist()
    return out


def calls(many: list[Call], comm: Communicator, settings: Settings | None = None) -> list[tuple[list[int], C.Replicated]]:
    """Allreduces (their numbers) with one result each, buf_id being the call's number; small ones of a kind share one if the
    settings ask for fusion."""
    settings = settings or Settings()
    if settings.fusion:
        return fuse(many, comm, FusionLimits.of(settings))
    return [([i], allreduce(c.buffers.withColumn("buf_id", F.lit(i)), comm, c.count, c.op, c.dtype, settings)) for i, c in enumerate(many)]


CALLS = {
    "allreduce": C.allreduce,
    "reduce": C.reduce,
    "reduce_scatter": C.reduce_scatter,
    "broadcast": C.broadcast,
    "bcast": C.bcast,
    "allgather": C.allgather,
    "allgather_vector": lambda buffers, comm, **_: C.allgather_vector(buffers, comm),
    "allgatherv": C.allgatherv,
    "allgatherv_vector": lambda buffers, comm, **_: C.allgatherv_vector(buffers, comm),
    "alltoall": C.alltoall,
    "alltoall_vector": C.alltoall_vector,
    "alltoallv": C.alltoallv,
    "alltoallv_vector": lambda buffers, comm, **_: C.alltoallv_vector(buffers, comm),
    "send": p2p.send,
}
