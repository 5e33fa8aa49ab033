"""A Merkle manifest of a dataset: a digest of every row, a tree of runs of 16 in each source, and one root.

A leaf is the SHA-256 of a row's fields: ``-`` for null, else the UTF-8 length, ``:`` and the value. In a source, leaves
stand in the order of identifiers; every 16 neighbours become one node, level by level, until one is left, the source's
subroot. Subroots, ordered by source (null first, then by bytes), become the root in the same way.

Rows are numbered inside their source by range partitions and sums of counts, so no task sees a whole source. A bucket
is 4096 neighbours, aligned: three levels of the tree lie wholly inside it. Executors hand each bucket as an Arrow table to
DuckDB, whose queries take a level each: ordered string_agg over runs of 16, then sha256. Spark combines the buckets' roots
as the next round's nodes, 4096 times fewer, and on the way back joins to each bucket the proof from its root to the
dataset's; rows get the part inside their bucket and fold.

A null source is a source. A null identifier comes first in its source. Rows with equal identifiers are ordered by their
leaves; rows alike in all fields have neighbouring places, in any order. A null text is ``-``, an empty one ``0:``. A very
long text is hashed where it is read, and only digests are shuffled. Other columns are not looked at. An empty table has no
rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, meet, partitions, table

#: Children of a node, and the levels of the tree inside a bucket.
RUN, LEVELS = 16, 3
BUCKET = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest in hexadecimal.
DIGITS = 64

_TREE = ["named", "name"]
_PATHS = "lefts array<string>, rights array<string>, subroot string, root string"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """rows with pos, dense from 0 in each group, in the order of columns; and n, the group's rows.

    The order must tell rows apart well enough to be dealt to ranges; group columns have no nulls.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *group, *order).sortWithinPartitions(*group, *order)
    dealt = scratch.stash(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "dealt")
    # A group's rows in a task stand together, so their places differ from their positions by one number.
    parts = dealt.groupBy(*group, "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    parts = scratch.stash(parts.select(*group, "task", shift.alias("shift"), F.sum("rows").over(whole).alias("n")), "shifts")
    return meet(dealt, parts, [*group, "task"], "place").withColumn("pos", F.col("place") + F.col("shift")).drop("task", "place", "shift")


def _levels(n: int) -> int:
    """Levels of the tree in a bucket of a round in which its tree has n nodes."""
    return 0 if n <= 1 else 1 if n <= RUN else 2 if n <= RUN * RUN else LEVELS


_db = None


def _query(sql: str, nodes: pa.Table, params: list | None = None) -> pa.Table:
    """Runs SQL over an Arrow table, in one engine a process, with one thread and no files."""
    global _db
    if _db is None:
        import duckdb

        _db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    _db.register("nodes", nodes)
    try:
        return _db.sql(sql, params=params or []).to_arrow_table()
    finally:
        _db.unregister("nodes")


def _level_queries(levels: int) -> str:
    """run1 ... : pos and digests, joined, of the runs of each level; node1 ...: their digests."""
    out = ["node0 AS (SELECT pos, h FROM nodes)"]
    for k in range(1, levels + 1):
        out.append(f"run{k} AS MATERIALIZED (SELECT pos // {RUN} AS pos, string_agg(h, '' ORDER BY pos) AS run FROM node{k - 1} GROUP BY ALL)")
        out.append(f"node{k} AS (SELECT pos, sha256(run) AS h FROM run{k})")
    return "WITH " + ", ".join(out)


def _bucket_root(keys: list[str]):
    def run(nodes: pa.Table) -> pa.Table:
        n = nodes["n"][0].as_py()
        levels = _levels(n)
        root = _query(f"{_level_queries(levels)} SELECT h FROM node{levels}", nodes.select(["pos", "h"]))
        own = {k: nodes[k].slice(0, 1) for k in keys}
        return pa.table({**own, "pos": nodes["bucket"].slice(0, 1), "h": root["h"].cast(pa.string()), "n": pa.array([-(-n // BUCKET)], pa.int64())})

    return run


def _paths(columns: list[str], digests: bool):
    """Each node's siblings up to the root, by level, left and right of it; or (digests) what a row's proof comes to."""

    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        levels = _levels(nodes["n"][0].as_py())
        lefts, rights, subroot, root = (outer[c][0].as_py() for c in ("lefts", "rights", "subroot", "root"))
        own = [f"substr(run{k}.run, 1, {DIGITS} * (nodes.pos // {RUN ** (k - 1)} % {RUN}))" for k in range(1, levels + 1)]
        other = [f"substr(run{k}.run, {DIGITS} * (nodes.pos // {RUN ** (k - 1)} % {RUN}) + {DIGITS + 1})" for k in range(1, levels + 1)]
        joins = " ".join(f"JOIN run{k} ON run{k}.pos = nodes.pos // {RUN**k}" for k in range(1, levels + 1))
        params: list = []

        def given(value) -> str:
            params.append(value)
            return f"${len(params)}"

        own += [f"{given(x)}::VARCHAR" for x in lefts]
        other += [f"{given(x)}::VARCHAR" for x in rights]
        sub = "nodes.h" if subroot is None else f"{given(subroot)}::VARCHAR"
        kept = ", ".join(f"nodes.{c}" for c in columns)
        if digests:
            folded = "coalesce(nodes.other, nodes.h)"
            for left, right in zip(own, other, strict=True):
                folded = f"sha256({left} || {folded} || {right})"
            proof = " || ".join(x for pair in zip(own, other, strict=True) for x in pair) or "''"
            top = f"{given(root)}::VARCHAR"
            wanted = f"nodes.h AS leaf, {sub} AS subroot, {top} AS root, sha256({proof}) AS proof_sha256, {folded} AS folded_root"
            kinds = {"leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string()}
        else:
            top = f"{given(root)}::VARCHAR"
            wanted = f"[{', '.join(own)}]::VARCHAR[] AS lefts, [{', '.join(other)}]::VARCHAR[] AS rights, {sub} AS subroot, {top} AS root"
            kinds = {"lefts": pa.list_(pa.string()), "rights": pa.list_(pa.string()), "subroot": pa.string(), "root": pa.string()}
        found = _query(f"{_level_queries(levels)} SELECT {kept}, {wanted} FROM nodes {joins}", nodes, params)
        return pa.table({c: found[c].cast(kinds.get(c) or nodes.schema.field(c).type) for c in found.column_names})

    return run


def _climb(nodes: DataFrame, keys: list[str], scratch: Scratch) -> list[DataFrame]:
    """nodes (keys, pos, h, n), then the roots of their buckets, and of theirs, until each tree has one."""
    rounds = [nodes]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in nodes.schema if f.name in keys)
    while True:
        dealt = rounds[-1].select(*keys, "pos", "h", "n", F.floor(F.col("pos") / BUCKET).cast("long").alias("bucket"))
        rounds.append(scratch.stash(dealt.groupBy(*keys, "bucket").applyInArrow(_bucket_root(keys), f"{kinds}pos long, h string, n long"), "roots"))
        if rounds[-1].where("n > 1").isEmpty():
            return rounds


def _descend(nodes: DataFrame, outer: DataFrame, keys: list[str], columns: list[str], digests: bool = False) -> DataFrame:
    """Joins the proofs of buckets (keys, pos, lefts, rights, subroot, root) to the nodes in them."""
    dealt = nodes.withColumn("bucket", F.floor(F.col("pos") / BUCKET).cast("long"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in (nodes.schema[c] for c in columns))
    met = dealt.groupBy(*keys, "bucket").cogroup(outer.withColumnRenamed("pos", "bucket").groupBy(*keys, "bucket"))
    return met.applyInArrow(_paths(columns, digests), kinds + ("leaf string, subroot string, root string, proof_sha256 string, folded_root string" if digests else _PATHS))


@dataclass
class Manifest:
    """A dataset's tree, in tables of the shared folder.

    rows: a row's source (named, name), pos in it, h (the leaf), other (the leaf to be checked, if it is another), n (rows
    of the source) and the columns carried. trees: the rounds of the sources' trees; top: those of the subroots' tree.
    """

    rows: DataFrame
    trees: list[DataFrame]
    top: list[DataFrame]
    carried: list[str]
    scratch: Scratch = field(repr=False)

    def root(self) -> str | None:
        row = self.top[-1].first()
        return None if row is None else row["h"]

    def subroots(self) -> DataFrame:
        """(source, subroot), in the order of pos."""
        return self.top[0].select(F.when(F.col("named"), F.col("name")).alias("source"), "pos", F.col("h").alias("subroot"))

    def _bucket_proofs(self) -> DataFrame:
        """The proofs of the roots of the sources' first buckets."""
        none = F.array().cast("array<string>")
        outer = self.top[-1].select("pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
        for nodes in self.top[-2:0:-1]:
            outer = self.scratch.stash(_descend(nodes, outer, [], ["pos"]).withColumn("subroot", F.lit(None).cast("string")), "proofs")
        outer = self.scratch.stash(_descend(self.top[0], outer, [], _TREE).withColumn("pos", F.lit(0).cast("long")), "proofs")
        for nodes in self.trees[-2:0:-1]:
            outer = self.scratch.stash(_descend(nodes, outer, _TREE, [*_TREE, "pos"]), "proofs")
        return outer

    def proofs(self) -> DataFrame:
        """The carried columns of each row with lefts and rights (its siblings on each level, joined), subroot and root."""
        return _descend(self.rows, self._bucket_proofs(), _TREE, [*self.carried, "h"]).withColumnRenamed("h", "leaf")

    def checks(self) -> DataFrame:
        """The carried columns of each row with leaf, subroot, root, proof_sha256, folded_root (of the leaf to be checked)
        and verified."""
        found = _descend(self.rows, self._bucket_proofs(), _TREE, self.carried, digests=True)
        return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(df: DataFrame, fields=FIELDS, source: str = "source", ident: str = "doc_id", changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of df's rows. changed: columns by which fields are replaced in what checks() holds against the tree, as
    a copy of the dataset that has changed; nothing by default."""
    scratch, rest = Scratch(df.sparkSession), Scratch(df.sparkSession)
    own = leaf([F.col(f"`{c}`") for c in fields])
    other = F.lit(None).cast("string")
    if changed:
        differs = F.lit(False)
        for c, new in changed.items():
            differs |= ~new.eqNullSafe(F.col(f"`{c}`"))
        other = F.when(differs, leaf([changed.get(c, F.col(f"`{c}`")) for c in fields]))
    rows = df.select(F.col(source).isNotNull().alias("named"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"), F.col(ident).alias("ident"), own.alias("h"), other.alias("other"))
    # The number splits rows alike, of which there may be any number, over ranges.
    leaves = rest.stash(rows.withColumn("number", F.monotonically_increasing_id()), "leaves")
    placed = scratch.stash(numbered(leaves, _TREE, ["ident", "h", "number"], rest).drop("number"), "placed")
    trees = _climb(placed, _TREE, scratch)
    subroots = trees[-1].select(*_TREE, "h")
    top = scratch.stash(numbered(subroots, [], _TREE, rest), "subroots")
    rest.remove()
    return Manifest(placed, trees, _climb(top, [], scratch), ["ident"], scratch)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(docs, changed={"text": lower}).checks().withColumnRenamed("ident", "doc_id")


def _sql(levels: int = 8, top_levels: int = 8) -> str:
    """The same in SQL, a level of the trees by a pair of queries: up to 16**levels rows a source, and so many sources."""
    parts = []

    def climb(name: str, keys: str, upto: int) -> None:
        for k in range(upto):
            parts.append(f"{name}r{k + 1} AS MATERIALIZED (SELECT {keys}pos // {RUN} AS pos, string_agg(h, '' ORDER BY pos) AS run, (any_value(n) + {RUN - 1}) // {RUN} AS n FROM {name}{k} WHERE n > 1 GROUP BY {keys}pos // {RUN})")
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {keys}pos, sha256(run) AS h, n FROM {name}r{k + 1} UNION ALL SELECT {keys}pos, h, n FROM {name}{k} WHERE n <= 1)")

    field_ = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join([*map(field_, FIELDS[:-1]), field_(text)]) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    parts.append(f"d AS (SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS name, {hashed('text')} AS h, {hashed(lower)} AS low FROM documents)")
    parts.append(f"s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY named, name) AS n FROM d)")
    climb("s", "named, name, ", levels)
    parts.append(f"t0 AS MATERIALIZED (SELECT named, name, h, row_number() OVER (ORDER BY named, encode(name)) - 1 AS pos, count(*) OVER () AS n FROM s{levels})")
    climb("t", "", top_levels)
    parts.append("p AS (SELECT s0.*, t0.h AS subroot, t0.pos AS place FROM s0 JOIN t0 USING (named, name))")
    pairs, joins = [], []
    for name, column, upto, on in (("s", "pos", levels, "x.named = p.named AND x.name = p.name AND "), ("t", "place", top_levels, "")):
        for k in range(1, upto + 1):
            alias = f"{name}x{k}"
            joins.append(f"LEFT JOIN {name}r{k} {alias} ON {on.replace('x.', alias + '.')}{alias}.pos = p.{column} // {RUN**k}")
            at = f"{DIGITS} * (p.{column} // {RUN ** (k - 1)} % {RUN})"
            pairs.append((alias, f"substr({alias}.run, 1, {at})", f"substr({alias}.run, {at} + {DIGITS + 1})"))
    parts.append(f"c AS (SELECT p.doc_id, p.h AS leaf, p.low, p.subroot, (SELECT h FROM t{top_levels}) AS root, {', '.join(f'coalesce({left}, {chr(39) * 2}) AS l_{a}, coalesce({right}, {chr(39) * 2}) AS r_{a}, {a}.run IS NOT NULL AS on_{a}' for a, left, right in pairs)} FROM p {' '.join(joins)})")
    parts.append(f"f0 AS (SELECT *, CASE WHEN coalesce({_sql_crc32('doc_id::VARCHAR')} % 5 = 0, false) THEN low ELSE leaf END AS f FROM c)")
    for i, (a, _, _) in enumerate(pairs):
        parts.append(f"f{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN on_{a} THEN sha256(l_{a} || f || r_{a}) ELSE f END AS f FROM f{i})")
    proof = " || ".join(f"l_{a} || r_{a}" for a, _, _ in pairs)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(pairs)}"


def _sql_crc32(text: str) -> str:
    """CRC-32 of ASCII characters: each is added to the register, which is then shifted eight times."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x)::BIGINT] || list_transform(range(8), lambda k: -1::BIGINT)))"
    folded = f"list_reduce({steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)"
    return f"xor({folded}, 4294967295::BIGINT)"


OP11_SQL = _sql()
