"""Communicators: ordered groups of ranks, their parts, and the topology's colours."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.errors import InvalidArgument


@dataclass(frozen=True)
class Communicator:
    """size ranks from 0 on; members: for a part of a larger group, the ranks there, in order of the ranks here."""

    size: int
    name: str = "world"
    members: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if self.size < 1:
            raise InvalidArgument("a communicator has at least one rank")
        if self.members and len(self.members) != self.size:
            raise InvalidArgument("one member a rank")

    def ranks(self) -> Column:
        """All ranks, to explode: a literal sequence of as many as the communicator has."""
        return F.sequence(F.lit(0), F.lit(self.size - 1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.size).select(F.col("id").cast("int").alias("rank"))

    def handle(self, rank: int, device: object = None, context: object = None) -> Handle:
        """What one rank holds of the communicator."""
        return Handle(self, self.check_root(rank), device, context)

    def check_root(self, root: int) -> int:
        if not 0 <= root < self.size:
            raise InvalidArgument(f"root {root} is not below {self.size}")
        return root

    def global_rank(self, rank: int) -> int:
        return self.members[rank] if self.members else rank

    def local_rank(self, rank: int) -> int:
        if not self.members:
            return rank
        if rank not in self.members:
            raise InvalidArgument(f"rank {rank} is not in {self.name}")
        return self.members.index(rank)

    def split(self, colors: dict[int, int], keys: dict[int, int] | None = None) -> dict[int, Communicator]:
        """A communicator for each colour; ranks are ordered by key, then by rank. Every rank needs a colour."""
        if set(colors) != set(range(self.size)):
            raise InvalidArgument("every rank needs a colour")
        order = sorted(range(self.size), key=lambda r: ((keys or {}).get(r, 0), r))
        parts: dict[int, list[int]] = {}
        for r in order:
            parts.setdefault(colors[r], []).append(self.global_rank(r))
        return {c: Communicator(len(m), f"{self.name}/{c}", tuple(m)) for c, m in sorted(parts.items())}


@dataclass(frozen=True)
class Handle:
    """A rank's view: its number, the size, and the device and context it was made with, which Spark has no use for."""

    comm: Communicator
    rank: int
    device: object = None
    context: object = None

    @property
    def size(self) -> int:
        return self.comm.size


def split_table(ranks: DataFrame, color: str = "color", key: str | None = None) -> DataFrame:
    """(rank, color) with new_rank and new_size, for groups of any number of ranks."""
    part = Window.partitionBy(color)
    order = part.orderBy(*([key] if key else []), "rank")
    return ranks.withColumn("new_rank", (F.row_number().over(order) - 1).cast("int")).withColumn("new_size", F.count(F.lit(1)).over(part).cast("int"))


def topology(ranks: DataFrame, per_node: int) -> DataFrame:
    """Fixed colours: pairs (rank div 2), planes (rank mod 2), nodes (rank div per_node), peers across nodes."""
    r = F.col("rank")
    return ranks.select(
        "rank",
        F.floor(r / 2).cast("int").alias("pair"),
        (r % 2).cast("int").alias("plane"),
        F.floor(r / per_node).cast("int").alias("node"),
        (r % per_node).cast("int").alias("node_rank"),
    )


def topology_from(ranks: DataFrame, colours: dict[str, str]) -> DataFrame:
    """Colours as an environment gives them: for each name a text of one number a rank, joined by commas."""
    for name, text in colours.items():
        parts = text.split(",")
        if not all(p.strip().isdigit() for p in parts):
            raise InvalidArgument(f"{name}: not a list of colours: {text}")
        ranks = ranks.withColumn(name, F.get(F.lit([int(p) for p in parts]), F.col("rank")))
        if ranks.where(F.col(name).isNull()).first() is not None:
            raise InvalidArgument(f"{name}: a rank has no colour")
    return ranks
