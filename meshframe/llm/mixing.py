"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Targets: sources in code point order, null last, get the weights in turn and share all words in proportion; a target
stops at a multiple of its source's size and the excess is shared again by weight. Each document gets an exponential
key with its quality weight as rate, so small keys go to good documents. A source is read in whole epochs as often as
its target allows; what remains is taken in key order, up to the word at which the target is met.

Rows are written once with size and key. As documents are taken in order, all that has to be found for a source is the
row at which it stops: sums of buckets of keys give the bucket, sums of rows alike inside it the place. Buckets grow in
number with the rows, and rows that are alike are summed before they meet, so no task sees a whole source. Then each row
is compared with its source's stop, and stays where it is. The targets alone are found in one task, from a row a source.

The weight is a column, such as a quality score; by default words by words plus ten for each ASCII symbol that is no
sentence mark. A weight of null or NaN is the default one; documents of weight 0 or less come behind all others, in random
order too; those of infinite weight come first.

Keys are hashes of identifiers, so reruns agree. Ties of keys go by identifier, then by a digest of text and source; rows
alike in all of these can't be told apart, and as many of them are taken as the target needs. A null text has size 0 and
takes nothing; a null source is a source; a null identifier comes last among ties and is hashed by its text. A very long
text counts in whole. Repeated rows are documents of their own. Columns of the input are carried along, whatever their
names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, clean_text, meet, table

#: Buckets of keys in a source: at least so many, and one for so many rows.
BUCKETS, BUCKET_ROWS = 1024, 50_000
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Smaller weights count as this one; and by what the keys of weights of 0 are larger.
LEAST_WEIGHT, LAST = 1e-290, 1e300
#: The ASCII symbols but for . , ; : ! ? ' " ( ) -
SYMBOLS = r"#$%&*+/<=>@[\]^_`{|}~"


def words(text: str = "text") -> Column:
    return F.regexp_count(clean_text(text), F.lit(WORD)).cast("long")


def quality_weight(size: Column, text: str = "text") -> Column:
    """Words by words plus ten for each symbol: 1 for clean prose, near 0 for junk."""
    marks = F.length(clean_text(text)) - F.length(F.translate(clean_text(text), SYMBOLS, ""))
    return F.when(size > 0, size.cast("double") / (size + 10 * marks)).otherwise(F.lit(1.0))


def sampling_key(name: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential with rate weight; finite for every weight, and largest where there is none."""
    spread = -F.log(uniform(name, seed))
    return F.when(weight > 0, spread / F.greatest(weight, F.lit(LEAST_WEIGHT))).otherwise(spread * F.lit(LAST))


def uniform(name: Column, seed: str = "mix") -> Column:
    """In (0, 1), from 52 bits of an MD5 of a string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to those and target: the level at which capped and uncapped shares use up all words."""
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most)
    by_cap = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(onward))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.min_by("level", F.when(fits.isNotNull(), F.col("cap") / F.col("weight"))).over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


_ORDER = ("key", "no_ident", "ident", "digest")


def _stops(keyed: DataFrame, scratch: Scratch, weights, most: int) -> DataFrame:
    """(source, source_size, target, epochs, stop, part): where the last, fractional reading of a source stops.

    Rows before stop (a struct in the order of taking) are taken whole once more, and part words of stop itself.
    """
    spark = keyed.sparkSession
    buckets = max(BUCKETS, -(-keyed.count() // BUCKET_ROWS))
    bucket = F.least(F.floor(F.col("key") / (F.col("key") + 1) * buckets), F.lit(buckets - 1)).cast("long")
    rows = keyed.select("source", "size", *_ORDER, "row_id", bucket.alias("bucket"))
    sums = scratch.stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = scratch.stash(goals.select(_null(), _name(), "source_size", "target", "epochs", "rest"), "goals")

    def upto(order: list[str], value: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy("no_source", "name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # The bucket, then the rows alike, in which the words that remain run out.
    by_bucket = sums.select(_null(), _name(), "bucket", "words").withColumn("before", upto(["bucket"], "words"))
    last = by_bucket.join(goals.select("no_source", "name", "rest"), ["no_source", "name"]).where("before <= rest and rest < before + words")
    last = scratch.stash(last.select("no_source", "name", "bucket", (F.col("rest") - F.col("before")).alias("rest")), "last")
    alike = meet(rows.select(_null(), _name(), "size", *_ORDER, "row_id", "bucket"), last, ["no_source", "name", "bucket"], "row_id")
    alike = alike.groupBy("no_source", "name", "size", "rest", *_ORDER).agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("row_id"))
    alike = alike.withColumn("words", F.col("size") * F.col("copies")).withColumn("before", upto([*_ORDER], "words")).where("before <= rest and rest < before + words")
    left = F.col("rest") - F.col("before")
    alike = scratch.stash(alike.select("no_source", "name", *_ORDER, "row_id", "copies", F.floor(left / F.col("size")).cast("long").alias("whole"), (left % F.col("size")).alias("part")), "alike")
    several = alike.where("whole > 0")
    if several.count():
        # Which of several copies it is: they are numbered by the task that wrote them, and inside it.
        copies = meet(rows.select(_null(), _name(), *_ORDER, "row_id"), several.select("no_source", "name", *[F.col(c).alias(f"stop_{c}") for c in _ORDER], "whole"), ["no_source", "name"], "row_id")
        copies = copies.where(F.struct(*_ORDER) == F.struct(*[F.col(f"stop_{c}").alias(c) for c in _ORDER])).select("no_source", "name", "whole", "row_id", F.shiftright("row_id", 33).alias("task"))
        tasks = copies.groupBy("no_source", "name", "task").agg(F.count(F.lit(1)).alias("n")).withColumn("before", upto(["task"], "n"))
        place = F.row_number().over(Window.partitionBy("no_source", "name", "task").orderBy("row_id")) - 1
        found = copies.withColumn("place", place).join(tasks, ["no_source", "name", "task"]).where(F.col("before") + F.col("place") == F.col("whole"))
        found = scratch.stash(found.select("no_source", "name", F.col("row_id").alias("copy_id")), "copies")
        alike = alike.join(found, ["no_source", "name"], "left").withColumn("row_id", F.coalesce("copy_id", "row_id")).drop("copy_id")
    stop = F.struct(*_ORDER, "row_id")
    return scratch.stash(goals.join(alike.select("no_source", "name", stop.alias("stop"), "part"), ["no_source", "name"], "left").drop("rest"), "stops")


def _null() -> Column:
    return F.col("source").isNull().alias("no_source")


def _name() -> Column:
    return F.coalesce("source", F.lit("")).alias("name")


def mix(df: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", size: Column | None = None, weight: Column | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """Rows (the columns in carry, by default all of df's) as struct ``row`` with size, source_size, target and taken
    (words the mix takes, repeats counted).

    The result reads a table in the shared folder, which holds the rows; smaller ones on the way are removed.
    """
    scratch = Scratch(df.sparkSession)
    # Named apart from the columns that are carried along.
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(ident).alias("ident"), F.col(source).cast("string").alias("source"), F.xxhash64(text, source).alias("digest"), F.col(text).alias("text"), (words(text) if size is None else size).alias("size"), (F.lit(None).cast("double") if weight is None else weight.cast("double")).alias("weight"))
    own = own.withColumn("weight", F.coalesce(F.nanvl("weight", F.lit(None).cast("double")), quality_weight(F.col("size"))) if weight is not None else quality_weight(F.col("size")))
    name = F.coalesce(F.col("ident").cast("string"), F.md5(clean_text("text").cast("binary")))
    own = own.withColumn("key", sampling_key(name, F.col("weight"), seed)).withColumn("no_ident", F.col("ident").isNull())
    keyed = scratch.stash(own.select("row", "source", "size", *_ORDER, F.monotonically_increasing_id().alias("row_id")), "keyed")
    rest = Scratch(df.sparkSession)
    stops = _stops(keyed, rest, weights, most)
    out = meet(keyed.withColumns({"no_source": _null(), "name": _name()}), stops, ["no_source", "name"], "row_id")
    here = F.struct(*_ORDER, "row_id")
    once = F.when(here < F.col("stop"), F.col("size")).when(here == F.col("stop"), F.col("part")).otherwise(F.lit(0))
    rest.remove(keep=1)
    return out.select("row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once).cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#$%&*+/<=>@[\]^_`{|}~', '')) AS marks
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / CASE WHEN size > 0 THEN size::DOUBLE / (size + 10 * marks) ELSE 1.0 END AS key
  FROM w),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         sum(size)::DOUBLE * 3 AS cap
  FROM k GROUP BY source),
l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW c AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap) * weight) AS target
  FROM l),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM p
"""
