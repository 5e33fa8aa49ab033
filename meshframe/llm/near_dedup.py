"""Near-duplicate detection by HyperMinHash.

A document is its set of distinct five-word shingles (lower-cased; fewer words: the whole sequence). Equal sets are one
class, a node. Each class gets 256 registers (leading zeros and ten mantissa bits of the least hash of a bucket); empty
registers borrow from filled ones, and 51 bands of five registers give the keys by which classes meet. Of
127,500 random pairs at a similarity of 0.75, of 3 to 4,000 shingles, none misses all bands. Pairs that are compared are sifted by size and by the
collision-corrected register estimate, six standard errors below the threshold, and what passes is confirmed on the
full sets.

No bucket is expanded into all its pairs. In a hub round its members are compared with one of them, the hub, and links
become components; buckets that still hold several components get another hub, as long as that links something. What
is left then goes through an exact filter, so that no link is lost:

Members that can still meet through buckets share a pivot, the smallest set among them. As x ^ y = (x ^ p) ^ (y ^ p),
sets are similar only if their differences from the pivot share enough. The differences' shingles are filed from rare to
common, each only up to where what follows still leaves room for that much (prefix and place filter). Near copies of one
text differ from it in shingles of their own, so they hardly meet, however large the group is; sets that are no further
from the pivot than the threshold are linked to it without any further pair.

Sets are compared by 64-bit hashes of shingles whose words are hashed by BLAKE2; sets of one BLAKE2 digest of 128 bits are
equal.

Nulls and texts without words have an empty set and are linked with nothing. A row without an identifier is linked
with nothing and kept. Rows with one identifier and different texts are different nodes, judged each by its text; rows
alike in both are one. Ties don't matter: every choice among equals leaves the components the same. A very long text
is cut into words in pieces and only its set is held at once. Columns other than text and ident are not looked at.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm import shingles as sh
from meshframe.llm.common import Scratch, clean_text, table, tasks_for
from meshframe.llm.components import connected_components

#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Another hub round follows one in which at least one of so many pairs was linked.
WORTHWHILE = 50
#: Bucket members, pairs and shingles for each task; nodes that read one copy of a pivot.
MEMBERS_EACH, PAIRS_EACH, SHINGLES_EACH, PIVOT_READERS = 200_000, 20_000, 500_000, 2_000

_SIGNATURE = "doc_id long, text_key long, n_shingles long, set_hi long, set_lo long, regs binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a 2-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def _signatures(batches):
    for batch in batches:
        for first, sets in sh.grouped(batch.column("text")):
            hashes, at = _joined(sets)
            keys = np.array([sh.digest(s) for s in sets], np.int64)
            own = batch.slice(first, len(sets))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), pa.array(np.diff(at)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _binary(sh.registers(hashes, at))], names=["doc_id", "text_key", "n_shingles", "set_hi", "set_lo", "regs"])


def _bands(batches):
    for batch in batches:
        if len(batch):
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, sh.REGISTERS)
            keys = sh.band_keys(regs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("node")), sh.BANDS))], names=["key", "node"])


def _sets(batches):
    for batch in batches:
        for first, sets in sh.grouped(batch.column("text")):
            hashes, at = _joined(sets)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(sets)), pa.array(np.diff(at)), _binary(sh.registers(hashes, at)), lists], names=["node", "n", "regs", "hashes"])


def _sift(percent: int):
    """The pairs whose sizes and registers leave a chance."""
    def run(batches):
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in ("a_n", "b_n")]
            regs = [batch.column(c) for c in ("a_regs", "b_regs")]
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(*sizes, strict=True)):
                if 100 * min(x, y) >= percent * max(x, y):
                    guess, error = sh.estimate(*(np.frombuffer(c[i].as_buffer(), np.uint16) for c in regs), x, y)
                    keep[i] = guess >= percent / 100 - 6 * error
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """(a, b, linked) of distinct pairs: by their registers, then on the full sets."""
    def side(name, *columns):
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    met = pairs.join(side("a", "n", "regs"), "a").coalesce(n).join(side("b", "n", "regs"), "b").coalesce(n)
    hopeful = scratch.stash(met.select("a", "b", "a_n", "b_n", "a_regs", "b_regs").mapInArrow(_sift(percent), "a long, b long, a_n long, b_n long"), "hopeful")
    met = hopeful.join(side("a", "hashes"), "a").coalesce(n).join(side("b", "hashes"), "b").coalesce(n)
    both = met.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("sum"), F.size(F.array_intersect("a_hashes", "b_hashes")).alias("both"))
    linked = F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent
    return scratch.stash(both.select("a", "b", linked.alias("linked")), "checked")


def _differences(here: DataFrame, sets: DataFrame, members: int, scratch: Scratch) -> DataFrame:
    """(cluster, pivot, pn, node, component, n, nd, diff): each open node's difference from its cluster's pivot.

    A cluster is the components that meet in buckets, directly or through others.
    """
    n = tasks_for(here.sparkSession, members, MEMBERS_EACH)
    least = here.groupBy("key").agg(F.min("component").alias("lo")).coalesce(n)
    edges = here.join(least, "key").where("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct().coalesce(n)
    clusters = connected_components(edges, members, scratch).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    nodes = here.select("node", "component").distinct().join(clusters, "component", "left").withColumn("cluster", F.coalesce("cluster", "component")).coalesce(n)
    nodes = scratch.stash(nodes.join(sets.select("node", "n"), "node").coalesce(n), "open")
    # A cluster's pivot is copied for every so many nodes, so that no task meets a whole cluster.
    pivots = nodes.groupBy("cluster").agg(F.min(F.struct("n", "node")).alias("least"), F.ceil(F.count(F.lit(1)) / PIVOT_READERS).alias("copies"))
    pivots = scratch.stash(pivots.select("cluster", F.col("least.node").alias("pivot"), F.col("least.n").alias("pn"), "copies").coalesce(n), "pivots")
    large = pivots.where("copies > 1").select("cluster", "copies")
    nodes = nodes.join(large, "cluster", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64("node"), F.col("copies")), F.lit(0).cast("long"))).drop("copies")
    pivots = pivots.join(sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    met = nodes.join(sets.select("node", "hashes"), "node").join(pivots, ["cluster", "copy"])
    diff = F.concat(F.array_except("hashes", "pivot_hashes"), F.array_except("pivot_hashes", "hashes"))
    return scratch.stash(met.select("cluster", "pivot", "pn", "node", "component", "n", diff.alias("diff")).withColumn("nd", F.size("diff").cast("long")), "differences")


def _across(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of different components that can be linked, by a prefix and place filter on differences.

    With s = 100 + percent and t = 100 - percent, x and y are linked iff s * |x ^ y| <= t * (|x| + |y|), that is, iff
    their differences dx, dy from the pivot p share at least (s * (|dx| + |dy|) - t * (|x| + |y|)) / 2s shingles. A node
    that is not linked to the pivot has s * |dx| > t * (|x| + |p|), which bounds the share from below on either side,
    whatever the other node is. Two nodes that are both linked to the pivot are in one component through it.
    """
    spark = apart.sparkSession
    s, t = 100 + percent, 100 - percent
    n = tasks_for(spark, apart.agg(F.sum("nd")).first()[0] or 0, SHINGLES_EACH)
    whole = lambda x: F.floor(x / (2 * s))
    nodes = apart.withColumn("linked", F.col("nd") * s <= (F.col("n") + F.col("pn")) * t)
    # Places up to which a shingle is filed: for meeting nodes that are not linked to the pivot, and for any others.
    nodes = nodes.withColumn("early", F.col("nd") - whole(F.col("nd") * s - (F.col("n") - F.col("pn")) * t))
    nodes = nodes.withColumn("late", F.when(F.col("linked"), F.col("early")).otherwise(F.col("nd") + 1 - whole(F.col("nd") * s - (F.col("n") + F.col("pn")) * t + 2 * s - 1)))
    filed = nodes.select("cluster", "node", "component", "n", "nd", "linked", "early", "late", F.explode("diff").alias("h")).coalesce(n)
    counts = filed.groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").coalesce(n)
    filed = filed.join(counts, ["cluster", "h"], "left").coalesce(n).withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "h")))
    # Shingles of one node alone take their places, but are met by no other.
    filed = filed.where("df is not null and place <= late").drop("df").coalesce(n)
    first = filed.where("place <= early").select("cluster", "h", *[F.col(c).alias(f"a_{c}") for c in ("node", "component", "n", "nd", "linked", "place")])
    second = filed.where("not linked").select("cluster", "h", *[F.col(c).alias(f"b_{c}") for c in ("node", "component", "n", "nd", "early", "place")])
    met = first.join(second, ["cluster", "h"]).where("a_component <> b_component").where("a_linked or (b_place <= b_early and a_node < b_node)")
    met = met.where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    room = F.least(F.col("a_nd") - F.col("a_place"), F.col("b_nd") - F.col("b_place")) + 1
    met = met.where(room * 2 * s >= (F.col("a_nd") + F.col("b_nd")) * s - (F.col("a_n") + F.col("b_n")) * t)
    return met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct().coalesce(n)


def _labels(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, component) of the nodes that are linked to a smaller one."""
    many = members.count()
    if not many:
        return None
    spark = members.sparkSession
    n, n_pairs = tasks_for(spark, many, MEMBERS_EACH), tasks_for(spark, many, PAIRS_EACH)
    here, labels, turn = members.withColumn("component", F.col("node")), None, 0
    while True:
        # The first hubs are alike in all buckets, which makes few pairs; later ones are any member of a bucket.
        rank = F.col("node") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
        hubs = here.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "component")).alias("hub")).coalesce(n)
        pairs = here.join(hubs, "key").where("component <> hub.component").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().coalesce(n)
        new = _verified(pairs, sets, percent, n_pairs, scratch)
        tried, made = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("linked").cast("long")), F.lit(0))).first()
        links = new.where("linked").select("a", "b")
        if made:
            labels = connected_components(links if labels is None else links.union(labels.select("node", "component")), many, scratch)
            here = here.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).coalesce(n)
        # Of two members, one was the hub and both are compared.
        still = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi and size > 2").select("key").coalesce(n)
        here = scratch.stash(here.join(still, "key").coalesce(n), "here")
        left = here.count()
        if not left:
            return labels
        turn, n = turn + 1, tasks_for(spark, left, MEMBERS_EACH)
        n_pairs = tasks_for(spark, left, PAIRS_EACH)
        if made * WORTHWHILE < tried or not made:
            break
    apart = _differences(here, sets, left, scratch)
    to_pivot = apart.where(F.col("nd") * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent)).where("node <> pivot")
    links = to_pivot.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    pairs = scratch.stash(_across(apart, percent), "pairs")
    links = links.union(_verified(pairs, sets, percent, tasks_for(spark, pairs.count(), PAIRS_EACH), scratch).where("linked").select("a", "b"))
    return connected_components(links if labels is None else links.union(labels.select("node", "component")), many, scratch)


def near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for every row of df; text_key: xxhash64 of the text.

    The result is read from a table in the shared folder; what was written on the way is removed.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(ident).cast("long").alias("doc_id"), clean_text(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    signatures = scratch.stash(docs.mapInArrow(_signatures, _SIGNATURE), "signatures")
    classes = signatures.where("n_shingles > 0 and doc_id is not null").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("least"))
    classes = scratch.stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    firsts = signatures.withColumnRenamed("doc_id", "least").join(classes, ["set_hi", "set_lo", "least"]).dropDuplicates(["set_hi", "set_lo", "least"]).select("node", "least", "text_key", "regs")
    firsts = scratch.stash(firsts, "firsts")
    banded = scratch.stash(firsts.select("node", "regs").mapInArrow(_bands, "key long, node long"), "bands")
    shared = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = scratch.stash(banded.join(shared, "key"), "members")
    near = firsts.select("node", F.col("least").alias("doc_id"), "text_key").join(members.select("node").distinct(), "node", "left_semi")
    near = docs.join(near, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("node", "text")
    sets = scratch.stash(near.mapInArrow(_sets, "node long, n long, regs binary, hashes array<long>"), "sets")

    labels = _labels(members, sets, percent, scratch)
    final = classes.select("set_hi", "set_lo", "node", "least")
    if labels is not None:
        linked = scratch.stash(final.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "linked")
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        final = linked.join(least, "component", "left")
    else:
        final = final.withColumn("component_id", F.col("least"))
    final = final.select("set_hi", "set_lo", F.coalesce("component_id", "least").alias("component_id"))
    out = signatures.drop("regs").join(final, ["set_hi", "set_lo"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = scratch.stash(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_key"), "near")
    scratch.remove(keep=1)
    return out


def drop_near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of df, with all their columns, that are kept: a row goes by its identifier and text, not by the former
    alone."""
    gone = near_duplicates(df, text, ident, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct()
    return df.join(gone, (df[ident].cast("long") == F.col("__gone")) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == F.col("__gone_key")), "left_anti")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


#: Every pair that shares a shingle is formed here, which only small tables bear.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS label FROM d UNION SELECT t.b, r.label FROM r JOIN t ON r.doc_id = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(label) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
