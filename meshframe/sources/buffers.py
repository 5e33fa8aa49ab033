"""Buffers as DataFrames.

Long form: (rank INT, buf_id INT, idx BIGINT, value), one row an element. Packed form: (rank, buf_id, chunk_id, values),
arrays of a fixed number of elements. Sources are any of Spark's readers; sinks are its writers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.functions.orders import spread

CHUNK = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_buffers(df: DataFrame, rank: Column, idx: Column, value: Column, buf_id: Column | int = 0) -> DataFrame:
    buf = F.lit(buf_id) if isinstance(buf_id, int) else buf_id
    return df.select(rank.cast("int").alias("rank"), buf.cast("int").alias("buf_id"), idx.cast("bigint").alias("idx"), value.alias("value"))


def arrays_to_buffers(df: DataFrame, rank: Column, vector: Column, values: Column, width: int, buf_id: Column | int = 0) -> DataFrame:
    """One array a row: the vector-th array of a rank starts at vector * width."""
    buf = F.lit(buf_id) if isinstance(buf_id, int) else buf_id
    rows = df.select(rank.cast("int").alias("rank"), buf.cast("int").alias("buf_id"), vector.cast("bigint").alias("vector"), F.posexplode(values).alias("pos", "value"))
    return rows.select("rank", "buf_id", (F.col("vector") * width + F.col("pos")).alias("idx"), "value")


def pack(buffers: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Long to packed: an element stands at place idx % chunk of its chunk; a rank has it once at most.

    Places before the last of a chunk that the rank has no element for are null, and false in held.
    """
    cell = F.struct((F.col("idx") % chunk).cast("int").alias("pos"), F.col("value").alias("value"), F.lit(True).alias("held"))
    cells = buffers.withColumn("chunk_id", F.floor(F.col("idx") / chunk)).groupBy("rank", "buf_id", "chunk_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    again = F.exists(F.sequence(F.lit(1), F.greatest(F.size("cells") - 1, F.lit(1))), lambda k: F.get("cells", k)["pos"] == F.get("cells", k - 1)["pos"])
    size = F.when(F.coalesce(again, F.lit(False)), F.raise_error(F.lit("a rank holds an element twice")).cast("int")).otherwise(F.element_at("cells", -1)["pos"] + 1)
    kind = buffers.schema["value"].dataType.simpleString()
    return cells.select("rank", "buf_id", "chunk_id", spread("cells", "pos", "value", size, kind).alias("values"), F.transform(spread("cells", "pos", "held", size, "boolean"), lambda h: F.coalesce(h, F.lit(False))).alias("held"))


def unpack(packed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Packed to long; without a column held, every place is an element."""
    cells = F.arrays_zip("values", "held") if "held" in packed.columns else F.transform("values", lambda v: F.struct(v.alias("values"), F.lit(True).alias("held")))
    rows = packed.select("rank", "buf_id", "chunk_id", F.posexplode(cells).alias("pos", "cell")).where("cell.held")
    return rows.select("rank", "buf_id", (F.col("chunk_id") * chunk + F.col("pos")).alias("idx"), F.col("cell.values").alias("value"))


#: Blocks in which positions are counted, at most; and the parts of a value that is a block by itself.
MOST_BLOCKS, PARTS = 10_000, 64


def positions(df: DataFrame, groups: list[str], order: str, block: int | None = None, name: str = "idx") -> DataFrame:
    return positions_and_counts(df, groups, order, block, name)[0]


def positions_and_counts(df: DataFrame, groups: list[str], order: str, block: int | None = None, name: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Dense positions from 0 in each group, in the order of a numeric column (nulls first); and (groups, n), from the same
    sums. Ties are ordered by a hash of the whole row.

    Blocks of about as many rows each (block of them, or what makes four to a shuffle partition) are cut at quantiles of the
    order, whatever its values; a value that is itself a quantile is a block of its own, dealt by hash to PARTS. Rows are
    numbered inside their block, and blocks start where the counts before them end: a group of any size is numbered by as
    many tasks as it has blocks, and the counts have a row a block at most.
    """
    spark = df.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) if block is None else -(-df.count() // block)
    wanted = max(1, min(MOST_BLOCKS, wanted))
    cuts = sorted(set(df.approxQuantile(order, [k / wanted for k in range(1, wanted)], 1 / (4 * wanted)))) if wanted > 1 else []
    value = F.col(order).cast("double")
    if cuts:
        array = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
        below = F.when(value >= cuts[0], last_up_to(array, value, len(cuts)) + 1).otherwise(F.lit(0))
        own = F.get(array, below - 1) == value
        number = F.when(F.coalesce(own, F.lit(False)), 2 * below - 1).otherwise(2 * below)
        alone = F.coalesce(own, F.lit(False))
    else:
        number, alone = F.lit(0), F.lit(False)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.withColumn("__hash", whole).withColumn("__block", F.when(value.isNull(), F.lit(-1)).otherwise(number))
    rows = rows.withColumn("__part", F.when(alone | value.isNull(), F.pmod("__hash", F.lit(PARTS))).otherwise(F.lit(0)))
    keys = [*groups, "__block", "__part"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__block", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "__hash")) - 1
    out = rows.withColumn("__inside", inside).join(starts, keys)
    out = out.withColumn(name, (F.col("__start") + F.col("__inside")).cast("bigint")).drop("__block", "__part", "__start", "__inside", "__hash")
    return out, counts.groupBy(*groups).agg(F.sum("__n").alias("n"))


def last_up_to(starts: Column, value: Column, most: int, of=lambda s: s) -> Column:
    """The place of the last of at most so many sorted starts that is not above a value, 0 if none is: bisection, a step for
    each doubling. of: from an entry to what it starts at."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(of(F.get(starts, low + step)) <= value, low + step).otherwise(low))


def write_bucketed(buffers: DataFrame, name: str, buckets: int) -> DataFrame:
    """Writes buffers as a table in buckets of (buf_id, idx), replacing one of that name; reductions of what is returned
    find an element's values in one bucket and need no exchange."""
    buffers.write.mode("overwrite").bucketBy(buckets, "buf_id", "idx").sortBy("buf_id", "idx").saveAsTable(name)
    return buffers.sparkSession.table(name)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "append") -> None:
    df.write.mode(mode).format(kind).save(path)
