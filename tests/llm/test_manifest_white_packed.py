"""Ops 11 to 13 against plain Python: a recursive tree, exact integers and numpy, the tokenizers library."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshframe.llm import merkle, packing, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- op 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """(root, the siblings of each leaf as (left, right) by level)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, place in enumerate(at):
            run = runs[place // 16]
            paths[k].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        at = [place // 16 for place in at]
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); gives the query's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        subroot, paths = plain_tree([plain_leaf(*r) for r in own])
        subroots.append(subroot)
        found.append((own, paths))
    root, tops = plain_tree(subroots)
    out = []
    for (own, paths), subroot, top in zip(found, subroots, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            folded = plain_leaf(*r[:4], text)
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((r[0], plain_leaf(*r), subroot, root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=str)


def checked(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op11_merkle(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def as_plain(rows):
    return [(d, s, lang, n, t) for d, t, lang, s, n in rows]


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [(i, f"Text {i} É", "en", f"s{i % 20}", i) for i in range(60)]
    rows += [(None, None, None, None, None), (7, "Null source", "en", None, 1), (7, "NULL source", "en", None, 1), (100, "", "", "", 0), (101, None, "de", "s1", None)]
    rows += [(200, "Twice", "en", "s2", 5)] * 3 + [(300, "A" * 100_000 + "é", "fr", "s3", 9)]
    assert checked(spark, tmp_path, rows) == plain_manifest(as_plain(rows))


def test_manifest_of_a_hot_source_and_many_sources(spark, tmp_path):
    rows = [(i, f"Doc {i}", "en", "hot", i) for i in range(4099)] + [(i, f"x{i}", None, f"s{i:03d}", 1) for i in range(300)]
    assert checked(spark, tmp_path, rows) == plain_manifest(as_plain(rows))


@pytest.mark.parametrize("n", [1, 16, 17, 257, 4096])
def test_manifest_of_one_source(spark, tmp_path, n):
    rows = [(i, f"D{i}", "en", "web", None) for i in range(n)]
    assert checked(spark, tmp_path, rows) == plain_manifest(as_plain(rows))


def test_manifest_of_nothing(spark, tmp_path):
    assert checked(spark, tmp_path, []) == []
    assert merkle.manifest(spark.createDataFrame([], DOCS)).root() is None


def test_manifest_takes_rounds_of_buckets(spark):
    """A source of more than 4096 ** 1 leaves takes two rounds; proofs fold to the root."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(None).cast("string").alias("lang"), F.col("id").alias("n_chars"), F.lit("t").alias("text"), F.lit(1).alias("h"), F.lit(2).alias("pos"))
    made = merkle.manifest(df)
    assert len(made.trees) == 3
    root = made.root()
    for r in made.proofs().sample(0.02, seed=1).collect():
        h = r["leaf"]
        for left, right in zip(r["lefts"], r["rights"], strict=True):
            h = sha(left + h + right)
        assert h == root == r["root"]
    assert [r["subroot"] for r in made.subroots().collect()] == [root]


def test_manifest_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(merkle.OP11_SQL).fetchall()
    assert sorted((tuple(r) for r in merkle.op11_merkle(spark, sf_dir).collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- op 12


def plain_white(vectors):
    """n, deviations, eigenvalues and the whitened values, by exact integers and numpy."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    exact = (n * (x.T @ x) - np.outer(s, s)).astype(object)
    cov = np.array([[float(v / (n * n)) for v in row] for row in exact])
    e, u = np.linalg.eigh(cov)
    return n, deviation, e[::-1], u[:, ::-1], np.array((n * x - s) / n, dtype=float), cov


def test_whitening_of_the_table(spark, sf_dir):
    import pyarrow.parquet as pq

    found = whitening.op12_whitening(spark, sf_dir).toPandas()
    assert list(found.columns)[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pandas()
    n, deviation, e, u, away, cov = plain_white([np.asarray(v, float) for v in table.embedding])
    assert set(found.n) == {n} and set(found.component) == set(range(1, 9)) and len(found) == 8 * n
    first = found[found.component == 1].set_index("vec_id")
    assert [int(v) for v in first.deviation[table.vec_id]] == deviation.tolist()
    for k in range(8):
        own = found[found.component == k + 1].set_index("vec_id")
        want, got = away @ u[:, k] / math.sqrt(e[k]), own.whitened[table.vec_id].to_numpy()
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert abs(own.explained.iloc[0] / (e[k] / np.trace(cov)) - 1) < 1e-9
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


EMBEDDINGS = "vec_id long, embedding array<float>, whitened int"


def whitened(spark, tmp_path, rows):
    spark.createDataFrame(rows, EMBEDDINGS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op12_whitening(spark, str(tmp_path)).collect()


def test_whitening_of_odd_vectors(spark, tmp_path):
    good = [[float(i % 7), float(i * i % 5), -0.0005 * i] for i in range(40)]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(None, good[3], 1), (3, good[3], 1)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    found = whitened(spark, tmp_path, rows + [(900 + i, v, 0) for i, v in enumerate(bad)])
    n, deviation, e, *_ = plain_white([np.float32(v).astype(float) for v in good + [good[3]] * 2])
    assert {r["n"] for r in found} == {42} and len(found) == 42 * 3 and sum(r["vec_id"] is None for r in found) == 3
    assert sorted(r["deviation"] for r in found if r["component"] == 1) == sorted(deviation.tolist())
    assert found[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5])
def test_whitening_without_variance(spark, tmp_path, rows):
    found = whitened(spark, tmp_path, rows)
    usable = [r for r in rows if r[1]]
    assert len(found) == 2 * len(usable)
    assert all(r["deviation"] == 0 and r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in found)


def test_whitening_beyond_longs(spark, tmp_path):
    rows = [(0, [3e38, 1.0], 0), (1, [-3e38, 2.0], 0), (2, [1e10, 5.0], 0)]
    found = whitened(spark, tmp_path, rows)
    x = np.array([[int(v) for v in row] for row in whitening.integers(np.array([r[1] for r in rows], np.float32).astype(float))], dtype=object)
    want = ((3 * x - x.sum(0)) ** 2).sum(1)
    got = {r["vec_id"]: (r["deviation"], int(r["deviation_exact"]) if r["deviation_exact"] is not None else None) for r in found}
    assert got == {i: (v if v < 1 << 63 else None, v if v < 10**38 else None) for i, v in enumerate(want)}


@settings(max_examples=60, deadline=None)
@given(st.integers(-(10**40), 10**40))
def test_remainders(value):
    moduli = whitening.primes(2 * 10**40)
    assert whitening.remainder([value % p for p in moduli], moduli) == value


def test_residues_are_exact():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(20_000, 3)) * 1e6
    batch = pa.RecordBatch.from_arrays([pa.array(c.tolist(), pa.list_(pa.float64()))], names=["embedding"])
    x = whitening.integers(c).astype(object)
    moduli = whitening.primes(2 * len(x) * int(np.abs(x).max()) ** 2)
    sums = {}
    for b in whitening.residues(3, moduli)(iter([batch])):
        for k, i, j, r in zip(*(b.column(name).to_pylist() for name in ("prime", "i", "j", "r")), strict=True):
            sums.setdefault((i, j), []).append(r)
    for i in range(3):
        for j in range(i, 3):
            assert whitening.remainder(sums[i, j], moduli) == int((x[:, i] * x[:, j]).sum())
        assert whitening.remainder(sums[i, 3], moduli) == int(x[:, i].sum())


# ---------------------------------------------------------------- op 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def hold_packed(rows, texts, library, window=packing.WINDOW):
    """Every id of every document in one piece, sequences gapless and in bounds; gives the share of padding. texts: a list,
    whose documents have distinct identifiers, as a dictionary."""
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    own, sequence = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(own) == set(ids)
    for i, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = used = 0
    for parts in sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        used += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / used


def test_packing_of_the_table(spark, sf_dir, library):
    import pyarrow.parquet as pq

    found = packing.op13_packing(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert hold_packed(found.collect(), dict(zip(table["doc_id"], table["text"], strict=True)), library) < 0.02


ODD = ["", None, "one", "It's İ, it's  ok!! x y", "a\x1cb \x1d", "<|endoftext|> x<|startoftext|>y", "é ́x", "1234 5,6", "日本語 テキスト", "x" * 5000, "word " * 30_000, "Don't 'S we're ÀÉ̀ Σς ΑΣ"]


def test_packing_of_odd_texts(spark, tmp_path, library):
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, piece int, start int").write.parquet(f"{tmp_path}/documents.parquet")
    hold_packed(packing.op13_packing(spark, str(tmp_path)).collect(), dict(enumerate(ODD)), library)


def test_packing_of_nothing_and_of_rows_alike(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op13_packing(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([(5, "a b c")] * 7 + [(None, None)] * 3, "doc_id long, text string")
    found = packing.pack_documents(df)[0].collect()
    assert sum(r["length"] for r in found) == 7 * 4 + 3 and sum(r["doc_tokens"] == 1 for r in found) == 3


def test_encoder_as_the_library(library):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    every = ["a" + chr(c) + "B, " + chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    for texts in (ODD, every):
        found = encoder.encode(pa.array([t or "" for t in texts]))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_sequences_hold_the_ids(spark, library):
    texts = {i: "some words of text " * (7 * i % 900) for i in range(40)}
    packed, cut = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ids=True)
    rows = packed.collect()
    found = {r["sequence_id"]: r for r in packing.sequences(packed, cut).collect()}
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    for r in rows:
        whole = np.frombuffer(found[r["sequence_id"]]["ids"], "<u4")
        assert whole[r["offset"] : r["offset"] + r["length"]].tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()
    assert sum(r["n_tokens"] for r in found.values()) == sum(map(len, ids.values()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_partitions(sizes, m):
    found = packing.difference(np.array(sizes), m)
    assert len(found) == m and sorted(i for w in found for i in w) == list(range(len(sizes)))


def test_differencing_evens_out():
    # The textbook case: 8, 7, 6, 5, 4 in two windows come to 16 and 14.
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference(np.array([8, 7, 6, 5, 4]), 2))
    assert sums == [14, 16]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 4000)
    sums = [int(sizes[w].sum()) for w in packing.difference(sizes, 300)]
    assert max(sums) - min(sums) <= 10  # of about 2,000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_windows_keep_their_capacity(sizes):
    found, risen = packing.windows(np.array(sizes, np.int64), 64)
    assert sorted(i for w in found for i in w) == list(range(len(sizes))) and risen >= 0
    assert all(sum(sizes[i] for i in w) <= 64 for w in found)


def test_windows_of_many_small_items():
    sizes = np.ones(300_000, np.int64)
    found, risen = packing.windows(sizes)
    assert risen == 0 and len(found) == -(-300_000 // 2048) and max(map(len, found)) <= 2048


def test_rests_of_one_length_are_cut(spark):
    """Rests of 1500 ids each would fill a window by three quarters, if none were cut."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), 1499).alias("text"))
    rows = packing.pack_documents(df)[0].collect()
    assert len({r["sequence_id"] for r in rows}) * 2048 <= 1.03 * 400 * 1500
