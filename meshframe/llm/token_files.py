"""Token ids in binary blocks, in ascending order of documents.

A block ranks its ids by their frequency in it (so that frequent ids take one byte) and stores the ranks in byte-aligned
variable length: two bits a value, four to a control byte, give the number of bytes, and the bytes follow in a stream of
their own. Both streams are read by table lookup: a control byte gives four lengths, their sums the places.

A block:  magic "TOK1", then as little-endian unsigned integers of 32 bits: documents, ids, distinct ids; then the
documents' lengths (32 bits each), the distinct ids from the most frequent on (32 bits), the control bytes, the data.

Blocks are rows of a Parquet table (range, seq, ...): Spark's writer reaches every store and commits only the output of
tasks that succeeded. Rows are dealt to ranges of identifiers and sorted; a block's start follows from sums of ranges
and blocks, so that nothing but counts meets in one place.

A null text is empty: the end id alone. A null identifier comes first. Rows with equal identifiers are ordered by a hash of
their text, then by the text; such rows, and repeated ones, are dealt to as many ranges as their number deserves. A very
long text is encoded in whole. Columns other than text and identifier are not looked at. Empty tables give no blocks. A
block holds about BLOCK_IDS ids, or one longer document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.bpe import _ODD as is_odd
from meshframe.llm.bpe import MARKS, Pieces, in_groups
from meshframe.llm.common import partitions, stash, table

MAGIC = b"TOK1"
END_ID = 0
BLOCK_IDS = 1 << 20
MOST_KNOWN, LONGEST_KEPT = 800_000, 64
#: The space in byte-level tokens; words that are encoded as one text, and such texts at once.
SPACE, STRETCH, STRETCHES = "\u0120", 256, 64

#: Four lengths for each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
_BLOCKS = "range int, seq int, n_ids long, doc_ids array<long>, block binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4", copy=False)
    size = np.ones(len(v), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        size += v >= limit
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    out = data[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(documents: list[bytes]) -> bytes:
    """documents: each document's ids as little-endian 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    control, data = pack(rank[ids])
    head = np.array([len(documents), len(ids), len(order)], "<u4").tobytes()
    lengths = np.array([len(d) // 4 for d in documents], "<u4").tobytes()
    return b"".join((MAGIC, head, lengths, order.tobytes(), control, data))


def read_block(block) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, the documents' lengths)."""
    raw = np.frombuffer(block, np.uint8)
    if raw[:4].tobytes() != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n, distinct = (int(x) for x in raw[4:16].view("<u4"))
    at = 16 + 4 * n_docs
    lengths, order = raw[16:at].view("<u4"), raw[at : at + 4 * distinct].view("<u4")
    at += 4 * distinct
    control_end = at + -(-n // 4)
    return order[unpack(raw[at:control_end], raw[control_end:], n)], lengths


class LibraryEncoder(Pieces):
    """The tokenizers library's ids of texts; each distinct piece goes through the library once, and many in one call.

    As in the library, the file's added tokens (such as "<|endoftext|>") are found in a text first, and have their own
    ids; words are cut from what lies between.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__(pattern)
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items() if t.content}
        #: Tokens that look at, or take in, what stands around them are left to the library.
        self.plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.known: dict[str, bytes] = dict(self.added)
        #: The same of words behind a space, without it.
        self.spaced: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        #: Whether words may stand side by side: no added token goes over from one to the next.
        self.joins = bool(self.starts.any()) and not any(" " in t for t in self.added)

    def parts_of(self, text: str) -> list[str]:
        """The text's words, with the added tokens between them."""
        if self.cut is None or not self.cut.search(text):
            return self.words_of(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.words_of(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words_of(text[at:])

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, here: set[str]) -> None:
        """Encodes the words that are not known yet."""
        known = self.known
        new = here.difference(known)
        if len(known) + len(new) > MOST_KNOWN:  # the words that occur here too are the ones that will again
            known = self.known = {w: known[w] for w in here.intersection(known)} | self.added
        asked, composed, odd = set(), [], []
        ask, compose = asked.add, composed.append
        for word in new:
            start = word[0] == " "
            if word[start:].isalpha():
                ask(word)  # a piece by itself
                continue
            core = word.rstrip(MARKS)
            if core[start:].isalpha():  # letters, then marks: two pieces
                tail = word[len(core) :]
                compose((word, core, tail))
                ask(core)
                ask(tail)
            else:
                odd.append((word, self.pieces(word)))
                asked.update(odd[-1][1])
        asked = list(asked.difference(known))
        for first in range(0, len(asked), 4096):
            some = asked[first : first + 4096]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[piece] = array("I", coded.ids).tobytes()
        for word, core, tail in composed:
            known[word] = known[core] + known[tail]
        for word, parts in odd:
            known[word] = b"".join([known[x] for x in parts])
        self.long = [k for k in (*asked, *new) if len(k) > LONGEST_KEPT]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each with a space before it; the words hold no space and start with no white space."""
        found = list(map(self.spaced.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        if len(self.spaced) + len(new) > MOST_KNOWN:  # the words that occur here too are the ones that will again
            self.spaced = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
        spaced, asked = self.spaced, [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        cores = [w.rstrip(MARKS) for w in others]
        composed = [c.isalpha() for c in cores]  # letters, then marks: two pieces
        asked += [w for w, two in zip(others, composed, strict=True) if not two]
        asked += {c for c, two in zip(cores, composed, strict=True) if two}.difference(spaced, asked)
        for first in range(0, len(asked), STRETCHES * STRETCH):
            self._ask(asked[first : first + STRETCHES * STRETCH])
        tails = {w[len(c) :] for w, c, two in zip(others, cores, composed, strict=True) if two}
        self._learn(tails)
        tail = {t: self.known[t] for t in tails}
        self._forget()
        spaced.update([(w, spaced[c] + tail[w[len(c) :]]) for w, c, two in zip(others, cores, composed, strict=True) if two])
        found = [spaced[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        for word in [w for w in (*asked, *new) if len(w) > LONGEST_KEPT]:
            spaced.pop(word, None)
        return found

    def _ask(self, words: list[str]) -> None:
        """Encodes words, each behind a space, many as one text: no piece goes on across a space before what is none, so a
        word begins with the one of its tokens that begins with a space. If such tokens come to another number than the
        words, each is encoded by itself."""
        stretches = [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)] if self.joins else [[w] for w in words]
        for some, coded in zip(stretches, self.tokenizer.encode_batch_fast([" " + " ".join(s) for s in stretches], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(self.starts[ids])
            if len(some) == 1:
                self.spaced[some[0]] = ids.tobytes()
            elif len(cuts) != len(some) or cuts[0]:
                self.spaced.update([(w, self.whole(" " + w)) for w in some])
            else:
                raw, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self.spaced.update(zip(some, [raw[x:y] for x, y in zip(at, at[1:], strict=False)], strict=True))

    def _forget(self) -> None:
        for key in self.long:
            self.known.pop(key, None)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers.

        Where single spaces alone part words, Arrow cuts the texts and numbers the distinct words, so that only these are
        looked up; a word takes the space before it with it, but for a text's first.
        """
        own, plain = {}, []
        for i, t in enumerate(texts):
            if self.cut is not None and self.cut.search(t):
                own[i] = self.encode_parts(t) if self.plain else self.whole(t)
            elif is_odd(t):
                own[i] = self.encode_parts(t)
            else:
                plain.append(t)
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        starts = np.asarray(split.offsets)[:-1]
        words = split.flatten()
        firsts = words.take(pa.array(starts)).to_pylist()
        coded = words.dictionary_encode()
        number, n = coded.indices.to_numpy().copy(), len(coded.dictionary)
        number[starts] = n + np.arange(len(firsts))
        used = np.bincount(number, minlength=n)[:n] > 0  # the others are firsts alone
        distinct = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        number = np.concatenate([np.cumsum(used) - 1, len(distinct) + np.arange(len(firsts))])[number]
        self._learn({*filter(None, firsts)})
        at_first = [self.known[w] if w else b"" for w in firsts]
        self._forget()
        found = self._spaced(distinct) + at_first
        taken = pa.array(found, pa.large_binary()).take(pa.array(number))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        raw = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
        at = ends[np.asarray(split.offsets)].tolist()
        rest = iter([raw[x:y] for x, y in zip(at, at[1:], strict=False)])
        return [own[i] if i in own else next(rest) for i in range(len(texts))]

    def encode_parts(self, text: str) -> bytes:
        parts = self.parts_of(text)
        self._learn(set(parts))
        out = b"".join(map(self.known.__getitem__, parts))
        self._forget()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path, pattern)


def _write(path: str, pattern: str, end_id: int, block_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part = _encoder(path, pattern), TaskContext.get().partitionId()
        documents, names, size, seq = [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([write_block(documents)], pa.binary())], names=["range", "seq", "n_ids", "doc_ids", "block"])

        for batch in batches:
            for group, texts in in_groups(batch):
                for name, ids in zip(group.column("doc_id").to_pylist(), encoder.encode_many(texts), strict=True):
                    documents.append(ids + end)
                    names.append(name)
                    size += len(documents[-1]) // 4
                    if size >= block_ids:
                        yield block()
                        documents, names, size, seq = [], [], 0, seq + 1
        if documents:
            yield block()

    return run


def _read(batches):
    for batch in batches:
        for i in range(len(batch)):
            ids, lengths = read_block(batch.column("block")[i].as_buffer())
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = ids.astype("<u4").tobytes()
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            part, seq = (pa.array([batch.column(c)[i].as_py()] * len(lengths), pa.int32()) for c in ("range", "seq"))
            yield pa.RecordBatch.from_arrays([part, seq, batch.column("doc_ids")[i].values, pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["range", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def write_tokens(df: DataFrame, text: str = "text", ident: str = "doc_id", path: str | None = None, pattern: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the blocks into the shared folder; returns the written table (range, seq, n_ids, doc_ids, block)."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    docs = df.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The number splits rows that are alike, whose order shows nowhere; texts of one hash stay in one order all the same.
    docs = docs.select("*", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("number"))
    order = ["doc_id", "key", "number"]
    ordered = docs.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    return stash(ordered.mapInArrow(_write(path, pattern, end_id, block_ids), _BLOCKS), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the blocks."""
    sizes = blocks.select("range", "seq", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(ranges, "range").select("range", "seq", (F.col("range_start") + F.col("inside")).alias("block_start"))
    read = blocks.mapInArrow(_read, "range int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["range", "seq"]).select("doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
