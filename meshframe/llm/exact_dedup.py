"""Exact deduplication by a content sort, in DataFrame operations only.

Every row gets a sort key: the leading bytes of its normalised text, the text's SHA-256 and its identifier. Splitters
from a bounded sample of keys deal the rows to ranges; each range is sorted (externally, by Spark) on key prefix, whole
text and identifier, so equal texts stand side by side. Each row is compared in full with its neighbour; a row that
differs from the one before opens a run. Identifiers are part of the splitters, so a group of copies of any size is
dealt to several ranges. The sorted rows are written once, without their texts unless these are asked for. Only the first
and the last run of a range can go on in another range; these, two a range at most, are written with their whole texts
and matched on them.

Nulls: a null text counts as empty. A very long text is compared in whole, and sorted by Spark like any other. Rows without an identifier come last within their group, and stay only if the
whole group has none. Repeated rows are copies like any other: of rows alike in text and identifier one stays. Empty
tables give empty results. All columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.common import clean_text, partitions, stash, table

PREFIX_BYTES = 24
#: Ranges for each shuffle partition, so that hashing range numbers to partitions stays even.
RANGES_EACH = 4
#: The most ranges, and the sampled keys for each: together they bound what the driver holds (about 130 bytes a key).
MOST_RANGES, SAMPLED_EACH = 20_000, 24


def _sort_key(text: Column, digest: Column, ident: Column) -> Column:
    lead = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
    return F.concat(lead, digest, F.coalesce(F.lpad(F.hex(ident.cast("long")), 16, "0"), F.lit("G" * 16)))


def _splitters(keyed: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 keys that split a sample evenly."""
    rows, wanted = keyed.count(), ranges * SAMPLED_EACH
    if rows == 0:
        return []
    sample = keyed.sample(min(1.0, 1.1 * wanted / rows), seed=7).limit(2 * wanted).select("__key").collect()
    keys = sorted(r[0] for r in sample)
    step = len(keys) / ranges
    return sorted({keys[int(i * step)] for i in range(1, ranges)}) if keys else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """The number of splitters that are not above the key, found in two steps of about sqrt(n) comparisons."""
    if not splitters:
        return F.lit(0)
    width = math.isqrt(len(splitters)) + 1
    whole, coarse = F.split(F.lit(",".join(splitters)), ","), splitters[width - 1 :: width]
    # array(key) makes the key a lambda's variable: it is computed once a row, not once a comparison.
    low = F.transform(F.array(key), lambda k: F.struct(k.alias("k"), F.size(F.filter(F.split(F.lit(",".join(coarse)), ","), lambda s: s <= k)).alias("c") if coarse else F.lit(0).alias("c")))
    fine = F.transform(low, lambda x: x["c"] * width + F.size(F.filter(F.slice(whole, x["c"] * width + 1, F.lit(width)), lambda s: s <= x["k"])))
    return fine[0]


def content_sort(df: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "min", normalise=None, ranges: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """df's rows (the columns in carry, by default all) as struct ``row`` with keep_id, group_size, kept and text_sha256.

    keep: "min" keeps the smallest identifier of equal texts, "max" the largest. normalise: from a text column to what
    is compared (nothing by default). The result reads a table in the shared folder.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, ranges or RANGES_EACH * partitions(spark))
    body = clean_text(text) if normalise is None else normalise(clean_text(text))
    wanted = carry or df.columns
    carried = [c for c in wanted if c != text or normalise is not None]  # a text that is as it was goes once
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("__row") if carried else F.lit(None).alias("__row"), body.alias("__text"), F.col(text).isNull().alias("__null"), F.col(ident).alias("__id"))
    rows = rows.withColumn("__sha", F.sha2(F.encode("__text", "UTF-8"), 256))
    keyed = rows.withColumn("__key", _sort_key(F.col("__text"), F.col("__sha"), F.col("__id")))
    splitters = _splitters(keyed, ranges)
    dealt = keyed.withColumn("__range", _range_of(F.col("__key"), splitters)).withColumn("__lead", F.substring("__key", 1, 2 * PREFIX_BYTES)).drop("__key")

    first = F.col("__id").asc_nulls_last() if keep == "min" else F.col("__id").desc_nulls_last()
    in_order = Window.partitionBy("__range").orderBy("__lead", "__sha", "__text", first)
    opens = F.coalesce(F.lag("__text").over(in_order) != F.col("__text"), F.lit(True))
    runs = dealt.withColumn("__opens", opens)
    runs = runs.withColumn("__run", F.sum(F.col("__opens").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    # The order is the one the range is sorted in already, so neither window sorts again.
    run = Window.partitionBy("__range", "__run")
    pick = F.min if keep == "min" else F.max
    runs = runs.withColumn("__first", pick("__id").over(run)).withColumn("__count", F.count(F.lit(1)).over(run)).withColumn("__last", F.max("__run").over(Window.partitionBy("__range")))

    row = [F.col("__row")[c].alias(c) if c in carried else F.when(~F.col("__null"), F.col("__text")).alias(c) for c in wanted]
    edge = F.col("__opens") & ((F.col("__run") == 1) | (F.col("__run") == F.col("__last")))
    runs = runs.select(F.struct(*row).alias("row"), "__id", "__sha", "__range", "__run", "__opens", "__first", "__count", F.when(edge, F.col("__text")).alias("__edge"))
    runs = stash(runs, "runs")

    same = Window.partitionBy("__edge")
    edges = runs.where("__edge is not null").select("__range", "__run", pick("__first").over(same).alias("__keep"), F.sum("__count").over(same).alias("__size"), F.count(F.lit(1)).over(same).alias("__parts"))
    edges = edges.where("__parts > 1").drop("__parts")  # at most two rows a range
    out = runs.join(F.broadcast(edges), ["__range", "__run"], "left")
    keep_id = F.when(F.col("__size").isNull(), F.col("__first")).otherwise(F.col("__keep"))
    return out.select("row", keep_id.alias("keep_id"), F.coalesce("__size", "__count").alias("group_size"), (F.col("__opens") & keep_id.eqNullSafe(F.col("__id"))).alias("kept"), F.col("__sha").alias("text_sha256"))


def exact_dedup(df: DataFrame, **options) -> DataFrame:
    """The rows of df that stay, with df's columns."""
    return content_sort(df, **options).where("kept").select("row.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts in documents; the row with the largest doc_id stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort(docs, keep="max", carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), false) AS kept, sha256(t) AS text_sha256
FROM d
"""
