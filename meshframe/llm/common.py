"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads a table through Spark, so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set, one machine's temporary folder serves a local session; on a cluster it would not be shared, so
    there it is an error.
    """
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _own_dir = _own_dir or tempfile.mkdtemp(prefix="meshframe-")
    return path.rstrip("/")


class Scratch:
    """Tables written into the shared folder to cut the lineage, and their removal.

    Parquet rather than checkpoint() where columns are wide: it is compressed, and later reads prune columns.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stash(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.paths.append(path)
        try:
            df.write.option("compression", "zstd").parquet(path)
        except BaseException:
            self.remove()  # nothing reads them any more
            raise
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, keep: int = 0) -> None:
        """Removes all tables but the last `keep`, which the caller still reads."""
        gone = self.paths[: len(self.paths) - keep]
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
        self.paths = self.paths[len(gone) :]


def stash(df: DataFrame, label: str) -> DataFrame:
    """A table that stays as long as the shared folder does."""
    return Scratch(df.sparkSession).stash(df, label)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks rows deserve, at each rows a task: as many as there are cores at least, and no more than a shuffle
    has. Tables that are small beside the corpus are coalesced to it, so that they don't cost a task a partition."""
    return max(1, min(partitions(spark), max(spark.sparkContext.defaultParallelism, -(-rows // each))))


#: Rows of a table that every task may hold beside its own; and the rows of one key that one task joins.
MOST_HELD, KEY_ROWS = 50_000, 500_000


def meet(rows: DataFrame, few: DataFrame, keys: list[str], own: str, most: int | None = None) -> DataFrame:
    """rows joined to few on keys, however many rows share a key: few is broadcast as long as it has no more than most
    rows by count; else a key is dealt to as many parts as its counted rows deserve, by column own, and its rows of few are
    copied to each. There are as many such keys as KEY_ROWS goes into the rows, at most."""
    if few.count() <= (MOST_HELD if most is None else most):
        return rows.join(F.broadcast(few), keys)
    hot = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / KEY_ROWS).alias("__parts")).where("__parts > 1")
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(own), parts)).drop("__parts")
    copies = few.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def clean_text(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def is_held_out(column: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
