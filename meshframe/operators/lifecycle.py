"""Start-up, versions, handles that Spark has no use for, and dry runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

import meshframe
from meshframe.operators.comm import Communicator


def init(**config: str) -> SparkSession:
    """The session to work in; made with config if there is none."""
    builder = SparkSession.builder
    for key, value in config.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Version:
    major: int
    minor: int
    update: int

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.update}"


def library_version() -> Version:
    return Version(*map(int, meshframe.__version__.split(".")))


@dataclass(frozen=True)
class Device:
    """Taken and ignored: Spark places work itself."""

    native: object = None


@dataclass(frozen=True)
class Context:
    native: object = None


@dataclass(frozen=True)
class Stream:
    """Taken and ignored: plans have the order that their data gives them."""

    native: object = None


def create_communicators(size: int, ranks: list[int], store: object = None, devices: dict[int, Device] | None = None) -> dict[int, Communicator]:
    """The communicator of each rank; in one driver they are the same object. A rendezvous store and devices are not needed."""
    comm = Communicator(size)
    return {comm.check_root(r): comm for r in ranks}


def dry_run(df: DataFrame) -> str:
    """The plan of a call, without running it."""
    return df._jdf.queryExecution().toString()
