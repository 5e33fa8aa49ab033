"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import is_held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, most: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of labelled rows that are not held out, about most[label] rows a label at most.

    Rows are chosen by a hash of the identifier, so reruns agree. The chosen labels are a proven few (the sum of most,
    and a tenth more), so they are broadcast to the documents. Labels that are null or contradict each other are left
    out.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), label.cast("int").alias("label")).where("label_id is not null and label is not null")
    known = known.where(~is_held_out("label_id"))
    counts = dict(known.groupBy("label").count().collect()) if most else {}
    rate = F.lit(0.0)
    for value, limit in most.items():
        rate = F.when(F.col("label") == value, F.lit(min(1.0, limit / max(1, counts.get(value, 0))))).otherwise(rate)
    drawn = F.pmod(F.xxhash64("label_id", F.lit("sample")), F.lit(1_000_003)) < rate * 1_000_003
    chosen = known.where(drawn).groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("label_id", "label")), F.col("doc_id") == F.col("label_id"))
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
