"""BPE and token blocks against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from meshframe.llm import bpe
from meshframe.llm import token_files as T

P = pytest.importorskip("public_tokenizers")

ODD = ["", "a", "  a  b \n c  ", " \x1c a\x1cb", "don't we'll 'sabc 123 4５6 ½²", "日本語 テスト", "　x  y  ", "a" * 31, "<|endoftext|> x", "\n\n\n x\n \n", "ab" * 700, "é" * 300, "\t x\r\ny", "🎉🎉 🎉", "x ", "the*** wörd%%%, end.\nNext"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_encodes_as_the_library(encoder, reference):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("abcdeé 'st\n.,12#\u00a0ß日", k=rng.randint(1, 80))) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_full_tables_change_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 3)
    for text in ODD:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_chains_append_and_edit(encoder, reference):
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choices(b"abcdet hing", k=rng.randint(0, 120)))
        chain = bpe.Chain(encoder, data)
        at = rng.randint(0, len(data))
        end, new = min(len(data), at + rng.randint(0, 5)), bytes(rng.choices(b"theq", k=rng.randint(0, 6)))
        chain.replace(at, end, new)
        data = data[:at] + new + data[end:]
        chain.append(b"ing")
        assert chain.ids() == reference._encode_single_piece(data + b"ing")
    long = bpe.Chain(encoder, b"the thing that " * 500)
    assert long.replace(100, 103, b"xyz") < 1000  # what lies far behind an edit is not computed again


def test_op5(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = bpe.op5_bpe(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


def test_null_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "x y", "c")], "doc_id long, text string, ids string")
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in bpe.encode_documents(df).collect()) == [("1", 0), ("1", 2), ("None", 0)]
    assert bpe.digest_documents(df.limit(0)).count() == 0


def test_variable_length_coding():
    rng = np.random.default_rng(0)
    for values in ([], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], rng.integers(0, 1 << 32, 999)):
        v = np.array(values, "<u4")
        control, data = T.pack(v)
        assert (T.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)) == v).all()


def test_blocks():
    documents = [np.array(d, "<u4").tobytes() for d in ([5, 5, 7, 0], [0], [50000, 5, 0])]
    ids, lengths = T.read_block(T.write_block(documents))
    assert ids.tolist() == [5, 5, 7, 0, 0, 50000, 5, 0] and lengths.tolist() == [4, 1, 3]
    with pytest.raises(ValueError):
        T.read_block(b"nothing of the kind")


def test_op10(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in T.op10_token_files(spark, sf_dir).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(out) == len(texts)


def test_added_tokens_are_those_of_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*ODD, end, f"{end} x a{end}b", f"a b {end}{end}\n", f" {end} ", "<|endoftext| > <|endof", f"x.{end}, the {end[:-1]}{end}"] * 2
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = T.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert want[len(ODD) + 1] == [50256, 2124, 257, 50256, 65]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == want
    monkeypatch.setattr(T, "MOST_KNOWN", 3)
    assert [np.frombuffer(encoder.encode_many([t])[0], "<u4").tolist() for t in texts] == want
    out = T.read_tokens(T.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in sorted(out, key=lambda r: r["start"])] == [(len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for i in want]


def test_words_go_to_the_library_together(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, asked = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

        encode = tokenizer.encode

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeghinorstüé", k=rng.randint(1, 12))) + rng.choice(["", "", ".", ",%", ".\nThe", "\u00a0x", "\u0120", "9", "\x1c"]) for _ in range(4000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, 4000, 400)] + ["", " a", "b", "w" * 99 + " " + "w" * 99 + ". " + "w" * 99]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids = lambda e: [np.frombuffer(x, "<u4").tolist() for x in e.encode_many(texts)]
    encoder = T.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    encoder.tokenizer = Counted()
    assert ids(encoder) == want and len(asked) < 100
    assert ids(encoder) == want and len(asked) < 110 and max(map(len, encoder.spaced)) <= T.LONGEST_KEPT
    encoder.starts[:], encoder.spaced = False, {}  # nothing tells where a word begins
    assert ids(encoder) == want
    monkeypatch.setattr(T, "MOST_KNOWN", 500)
    assert ids(encoder) == want and ids(encoder) == want


def test_added_tokens_that_take_in_spaces(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.add_special_tokens([AddedToken("<s>", lstrip=True, rstrip=True), AddedToken("<word>", single_word=True)])
    tokenizer.save(str(tmp_path / "t.json"))
    texts = ["a  <s>  b", "x<word>y <word> z", "plain text", "<|endoftext|> <s>a"]
    encoder = T.LibraryEncoder(str(tmp_path / "t.json"), P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_blocks_nulls_and_ties(spark):
    df = spark.createDataFrame([(3, "c d"), (1, None), (2, ""), (3, "a"), (None, "n"), (9, "z " * 50)], "doc_id long, text string")
    out = T.read_tokens(T.write_tokens(df, block_ids=3)).collect()
    assert [(r["doc_id"]) for r in sorted(out, key=lambda r: r["start"])] == [None, 1, 2, 3, 3, 9]
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out)[:4] == [("1", 1), ("2", 1), ("3", 2), ("3", 3)]
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert T.read_tokens(T.write_tokens(df.limit(0))).count() == 0


def test_hot_identifiers_and_long_texts(spark):
    """Most rows share an identifier or are alike; a text is longer than a block; columns have clashing names."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    long = "The long text goes on, word by word. " * 8000
    rows = [(5, f"text {i % 9}", "k") for i in range(400)] + [(5, "alike", "k")] * 400 + [(7, long, "k"), (None, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(6)
    blocks = T.write_tokens(df, block_ids=500)
    assert blocks.where("size(doc_ids) > 0").select("range").distinct().count() > 2
    out = sorted(T.read_tokens(blocks).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] + [5] * 800 + [7]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(r["ids_crc32"] for r in out) == sorted(crc(t or "") for _, t, _ in rows)
    again = sorted(T.read_tokens(T.write_tokens(df.repartition(3), block_ids=500)).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in again] == [tuple(r) for r in out]
    assert T.read_tokens(T.write_tokens(df.limit(0))).count() == 0


def test_bpe_of_a_long_text_and_repeated_rows(spark, reference):
    long = "Ein langer Text, mit Wörtern\u00a0und 123 Zahlen.\n" * 20_000 + "x" * 3000
    df = spark.createDataFrame([(1, long), (1, long), (2, "a")], "doc_id long, text string")
    out = sorted(bpe.encode_documents(df).collect())
    assert out[0]["ids"] == out[1]["ids"] == reference.encode_ordinary(long) and out[2]["ids"] == reference.encode_ordinary("a")
