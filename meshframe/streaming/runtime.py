"""How calls run: attributes, events, fusion, and reductions of streams.

A call is a plan, and running it is a Spark action. start() runs one beside the driver's own code, in the scheduler pool of
its priority and under a tag of its own: Spark's scheduler shares the executors among pools (set spark.scheduler.mode to
FAIR and give the pools weights), and an event can be cancelled by its tag. Small allreduces of one kind are fused: their
buffers become one union with buf_id as part of the grouping key, so that many calls cost one exchange.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument, Unsupported
from meshframe.functions.datatypes import REGISTRY
from meshframe.functions.pairwise import Pairwise
from meshframe.functions.reductions import PROD, reduction
from meshframe.operators.collectives import Replicated, allreduce
from meshframe.operators.comm import Communicator
from meshframe.plans.settings import Settings


@dataclass(frozen=True)
class OpAttr:
    """Options of a call; planned.call() and start() read them."""

    #: With priorities direct, the pool that the call's jobs run in.
    priority: int = 0
    #: Keeps the result, for calls whose result is read again.
    to_cache: bool = False
    #: Waits for the call before start() returns.
    synchronous: bool = False
    match_id: str = ""
    #: The name space of messages.
    group_id: int = 0
    #: A reduction of the caller's own: from a column to an aggregate, or Pairwise.
    reduction_fn: Callable | None = None
    #: Whether the blocks of a gather or exchange come as a buffer for each sender.
    vector_buf: bool = False

    def get(self, name: str):
        if name not in self.__dataclass_fields__:
            raise InvalidArgument(f"no attribute {name}")
        return getattr(self, name)

    def set(self, name: str, value) -> OpAttr:
        """A copy with the attribute; its type is the one that it has."""
        old, kinds = self.get(name), {"reduction_fn": (Callable, Pairwise, type(None))}
        if not isinstance(value, kinds.get(name, type(old))) or (isinstance(value, bool) and not isinstance(old, bool)):
            raise InvalidArgument(f"{name}: not of the attribute's type: {value!r}")
        return replace(self, **{name: value})


class Event:
    """A running call: the future of its action."""

    def __init__(self, spark: SparkSession, tag: str, future: Future):
        self._spark, self._tag, self._future = spark, tag, future

    def wait(self):
        return self._future.result()

    def test(self) -> bool:
        return self._future.done()

    __bool__ = test

    def cancel(self) -> None:
        """Cancels the call's jobs; wait() then raises what Spark does."""
        self._spark.sparkContext.cancelJobsWithTag(self._tag)


def pool(attr: OpAttr, settings: Settings) -> str | None:
    """The scheduler pool of a call; None for the default one."""
    return f"priority-{attr.priority}" if settings.priority == "direct" else None


def start(spark: SparkSession, action: Callable[[], object], attr: OpAttr | None = None, deps: tuple[Event, ...] = (), settings: Settings | None = None) -> Event:
    """Runs an action, such as a write, once the calls in deps are done; it fails if one of them does."""
    attr, settings = attr or OpAttr(), settings or Settings()
    tag, future, context = f"call-{uuid.uuid4().hex}", Future(), spark.sparkContext

    def run() -> None:
        try:
            for d in deps:
                d.wait()
            context.addJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", pool(attr, settings))
            future.set_result(action())
        except BaseException as e:
            future.set_exception(e)

    threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()
    event = Event(spark, tag, future)
    if attr.synchronous or settings.op_sync:
        event.wait()
    return event


@dataclass(frozen=True)
class Call:
    """An allreduce to be fused."""

    buffers: DataFrame
    count: int
    dtype: str = "float32"
    op: str = "sum"
    attr: OpAttr = OpAttr()


@dataclass(frozen=True)
class FusionLimits:
    bytes_threshold: int = 16384
    count_threshold: int = 256
    #: Whether a call of a higher priority than those waiting closes their group.
    check_urgent: bool = True

    @classmethod
    def of(cls, settings: Settings) -> FusionLimits:
        return cls(settings.fusion_bytes_threshold, settings.fusion_count_threshold, settings.fusion_check_urgent)


def fuse(calls: list[Call], comm: Communicator, limits: FusionLimits | None = None) -> list[tuple[list[int], Replicated]]:
    """Groups of calls (their numbers) with one result each, whose buf_id is the call's number.

    Calls join if they are small, of one type and reduction, and not synchronous; a group is closed when it is full, or
    when a more urgent call comes, which then closes all groups and its own with it.
    """
    limits = limits or FusionLimits()
    groups: list[list[int]] = []
    open_groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(calls):
        size = c.count * REGISTRY[c.dtype].bytes
        if callable(c.op) or c.attr.synchronous or size >= limits.bytes_threshold:
            groups.append([i])
            continue
        key = (c.dtype, c.op)
        if limits.check_urgent and any(c.attr.priority > calls[k].attr.priority for g in open_groups.values() for k in g):
            if key in open_groups:
                open_groups[key].append(i)
            else:
                groups.append([i])
            open_groups.clear()
            continue
        held = open_groups.setdefault(key, [])
        if not held:
            groups.append(held)
        held.append(i)
        if len(held) >= limits.count_threshold:
            del open_groups[key]
    out = []
    for numbers in groups:
        frames = [calls[i].buffers.withColumn("buf_id", F.lit(i)) for i in numbers]
        first = calls[numbers[0]]
        out.append((numbers, allreduce(reduce(DataFrame.unionByName, frames), comm, first.op, first.dtype)))
    return out


def stream_allreduce(stream: DataFrame, comm: Communicator, sink: Callable[[DataFrame, int], None], op: str = "sum", dtype: str = "int64"):
    """A Structured Streaming writer that reduces each micro-batch of buffers and hands the rows to sink."""
    if callable(op):
        raise Unsupported("streams take built-in reductions")
    return stream.writeStream.foreachBatch(lambda batch, number: sink(allreduce(batch, comm, op, dtype).expand(), number))


def running_allreduce(stream: DataFrame, at: str, window: str, delay: str, op: str = "sum", dtype: str = "int64", ident: str | None = None) -> DataFrame:
    """Running reductions of a stream of buffers: (start, buf_id, idx, value) of each window of the event time at.

    State is kept for each window and element, partial results first, and goes when the watermark (the latest time seen,
    less delay) has passed the window; what comes later than that is left out. ident: a column by which rows that are sent
    again are told, within the delay. In append mode a window is given once, when it is closed; in update mode as it grows.
    """
    if callable(op) or op == PROD and REGISTRY[dtype].kind != "float":
        raise Unsupported("streams take sums, products of floats, minima and maxima")
    rows = stream.withWatermark(at, delay)
    if ident is not None:
        rows = rows.dropDuplicatesWithinWatermark([ident])
    out = rows.groupBy(F.window(at, window).alias("w"), "buf_id", "idx").agg(reduction(op, F.col("value"), REGISTRY[dtype]).alias("value"))
    return out.select(F.col("w.start").alias("start"), "buf_id", "idx", "value")
