"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which are sequences by themselves, and a rest. Rests are dealt to blocks of
about BLOCK tokens, whose number follows from the sum of all rests, so a block is bounded whatever the table. In a block
every rest starts as a partition into m windows, one of them filled; the two partitions of the largest imbalance are merged,
the fullest windows of the one with the emptiest of the other, until a single partition of near-equal windows is left.
m starts at the number of windows that the tokens fill; where a window of the outcome exceeds its capacity, m rises by one.

Whole rests leave imbalances of their own size, so every fourth is cut in graded parts (halves down to LEAST tokens),
which come last in the differencing and even out what the large ones left. If the number of windows rises by more than a
hundredth all the same, twice as many rests are cut, at last all.

A sequence is padded to a window, unless its length is a power of two. A null text is an empty one: the end id alone. A
null identifier stays null. Repeated rows are packed each for itself; rows are told apart by a number, so ties don't
matter. A very long text is encoded in whole, and only its rest meets other documents. Other columns are not looked at.
Empty tables give no pieces. The tokenizer file's added tokens are matched in a text, as the library does. Sequence ids are
distinct, not dense.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.bpe import MARKS, SPACES
from meshframe.llm.common import Scratch, table

WINDOW, END_ID = 2048, 1
#: Tokens of a block; one rest in CUT_EACH is cut to parts of LEAST tokens at least; rests for a window before small ones are joined.
BLOCK, CUT_EACH, LEAST, MOST_EACH = 1 << 19, 4, 8, 64
#: Words whose ids are kept by a process, and the longest of them.
MOST_KNOWN, LONGEST_KEPT = 800_000, 48
#: What a token ends with that ends a word; words of letters that are encoded as one text, and such texts at once.
WORD_END, STRETCH, STRETCHES = "</w>", 256, 64
#: Windows of a block are fewer than this.
_WINDOWS = 1 << 20

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cut_crcs array<long>"
_PLACED = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """The tokenizers library's ids of texts, for tokenizers that drop white space: words between white space are encoded
    by themselves, each distinct one once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added, self.known = added, {"": b""}
        self.lowers = self.tokenizer.encode("AZ", add_special_tokens=False).ids == self.tokenizer.encode("az", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.spaces = re.compile(f"[{SPACES}]+")

    def _odd(self, text: str) -> bytes:
        """The ids of a text that holds added tokens, or what is white space to Arrow but not to the tokenizer."""
        out, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            words = [w for w in self.spaces.split(text[at : m.start() if m else len(text)]) if w]
            self._learn({w for w in words if w not in self.known})
            out += [self.known[w] for w in words]
            if m:
                out.append(self.added[m[0]])
                at = m.end()
        return b"".join(out)

    def _learn(self, words: set[str]) -> None:
        known = self.known
        letters = {w for w in words if w.isalpha()}
        odd, composed = [], []
        for w in words.difference(letters):
            core = w.rstrip(MARKS)
            if core.isascii() and core.isalpha():  # letters, then marks: two tokens of the pattern
                composed.append((w, core, w[len(core) :]))
            else:
                odd.append(w)
        letters.update([core for _, core, _ in composed])
        odd += {tail for *_, tail in composed}
        letters = list(letters.difference(known))
        for first in range(0, len(letters), STRETCHES * STRETCH):
            self._learn_letters(letters[first : first + STRETCHES * STRETCH])
        self._learn_each([w for w in odd if w not in known])
        for w, core, tail in composed:
            known[w] = known[core] + known[tail]

    def _learn_each(self, words: list[str]) -> None:
        for first in range(0, len(words), 4096):
            some = words[first : first + 4096]
            for w, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = array("I", coded.ids).tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """A word of letters ends with the first id that ends a word, so many are encoded as one text; if the ends come to
        another number than the words, each by itself."""
        stretches = [words[i : i + STRETCH] for i in range(0, len(words), STRETCH)]
        for some, coded in zip(stretches, self.tokenizer.encode_batch_fast([" ".join(s) for s in stretches], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids])
            if len(cuts) != len(some):
                self._learn_each(some)
                continue
            raw, at = ids.tobytes(), 0
            for w, cut in zip(some, (4 * cuts + 4).tolist(), strict=True):
                self.known[w] = raw[at:cut]
                at = cut

    def _odd_rows(self, texts: pa.Array, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(starts, np.flatnonzero((data >= 0x1C) & (data <= 0x1F)), "right") - 1] = True
        for token in self.added:
            odd |= np.asarray(pc.match_substring(texts, token))
        return odd

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian 32-bit integers.

        Arrow cuts texts into words and numbers the distinct ones, so that only these are looked up.
        """
        texts = pa.concat_arrays([texts.cast(pa.large_string())])  # from offset 0
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, offsets[-1])
        odd = self._odd_rows(texts, data, offsets[:-1])
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.lowers:
            # The tokenizer takes capitals as small letters. Where no mark could join a letter, as in Latin-1, they are made
            # so first: fewer words are distinct.
            beyond = np.zeros(len(texts), bool)
            beyond[np.searchsorted(offsets[:-1], np.flatnonzero(data > 0xC3), "right") - 1] = True
            plain = pc.if_else(pa.array(beyond), plain, pc.utf8_lower(plain))
        split = pc.utf8_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > MOST_KNOWN:  # frequent words come early, so the first ones stay
            self.known = known = dict(islice(known.items(), MOST_KNOWN // 2)) | {w: known[w] for w in words if w in known}
        self._learn(new)
        found = [known[w] for w in words]
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            known.pop(w, None)
        taken = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        raw = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
        at = ends[np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        out = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(odd):
            out[i] = self._odd(texts[int(i)].as_py())
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def graded(length: int, least: int = LEAST) -> list[int]:
    """Halves of what is left, down to least tokens."""
    out = []
    while length >= 2 * least:
        out.append(length - length // 2)
        length //= 2
    return [*out, length] if length else out


#: Texts are encoded together up to so many bytes.
TOGETHER = 4 << 20


def _groups(batch: pa.RecordBatch):
    """Stretches of a batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)
    part = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for first, end in zip(cuts, cuts[1:], strict=False):
        if end > first:
            yield batch.slice(first, end - first)


def _cut(path: str, window: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for rows in _groups(batch):
                names, starts, lengths, crcs, totals, counts, cuts, held = [], [], [], [], [], [], [], []
                for name, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(pc.fill_null(rows.column("text"), "")), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        begin = 0
                        if len(piece) < 4 * window:
                            for size in graded(len(piece) // 4):
                                cuts.append(zlib.crc32(piece[begin : begin + 4 * size]))
                                begin += 4 * size
                        counts.append(len(cuts))
                        names.append(name)
                        starts.append(at)
                        lengths.append(len(piece) // 4)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        if with_ids:
                            held.append(piece)
                full = np.array(lengths) == window
                ends = pa.array([0, *counts], pa.int32(), mask=np.append(full, False))  # null where a window is full
                columns = [*(pa.array(c, pa.int64()) for c in (names, starts, lengths, crcs, totals)), pa.ListArray.from_arrays(ends, pa.array(cuts, pa.int64()))]
                kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut_crcs"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.binary())] if with_ids else columns, names=[*kept, "ids"] if with_ids else kept)

    return run


def difference(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Multiway differencing: the numbers of the items in each of m windows."""
    n = len(sizes)
    if not n:
        return [[] for _ in range(m)]
    #: A partition: sums of its windows, falling, without what all have in common; and nodes, each an item or a pair of nodes.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    made, turn = n, n
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            sums, nodes = np.concatenate((a, b)), np.concatenate((in_a, in_b))
        else:
            sums, nodes = np.zeros(m, np.int64), np.full(m, -1, np.int64)
            sums[: len(a)], nodes[: len(a)] = a, in_a
            under = nodes[m - len(b) :]  # b's fullest windows with a's emptiest
            sums[m - len(b) :] += b[::-1]
            over = in_b[::-1]
            both = (under >= 0) & (over >= 0)
            pairs.append((under[both], over[both]))
            count = int(both.sum())
            joined = np.where(under >= 0, under, over)
            joined[both] = np.arange(made, made + count)
            nodes[m - len(b) :] = joined
            made += count
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == m:
            sums = sums - sums[-1]
        turn += 1
        heapq.heappush(heap, (-int(sums[0]), turn, sums, nodes))
    left = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    right = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    out = []
    for node in heap[0][3].tolist():
        held, items = [node], []
        while held:
            x = held.pop()
            if x >= n:
                held += [int(left[x - n]), int(right[x - n])]
            elif x >= 0:
                items.append(x)
        out.append(items)
    return out + [[] for _ in range(m - len(out))]


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[list[list[int]], int]:
    """Items in near-equal windows, as few as differencing fills; and how many more than their tokens would fill."""
    least = max(1, -(-int(sizes.sum()) // capacity))
    groups: list[list[int]] | None = None
    items = sizes
    if len(sizes) > MOST_EACH * least:  # small items, of which a window takes many, are joined
        first, held, groups = [], 0, []
        for i, s in enumerate(sizes.tolist()):
            if held == 0:
                groups.append([])
                first.append(0)
            groups[-1].append(i)
            held += s
            first[-1] = held
            if held >= capacity // MOST_EACH:
                held = 0
        items = np.array(first, np.int64)
    m = least
    while True:
        found = difference(items, m)
        if max((int(items[w].sum()) for w in found if w), default=0) <= capacity:
            break
        m += 1
    return (found if groups is None else [[i for g in w for i in groups[g]] for w in found]), m - least


def _pack(capacity: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("piece").combine_chunks()
        number = block["block"][0].as_py()
        piece, doc, start, length, crc, total = (block[c].fill_null(0).to_numpy() for c in ("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"))
        missing = np.asarray(block["doc_id"].is_null())
        each = CUT_EACH
        while True:
            cut = np.arange(len(block)) % each == 0
            sizes = [graded(n) for n in length[cut].tolist()]
            inner = np.array([0, *np.cumsum([len(s) for s in sizes])])
            flat = np.array([n for s in sizes for n in s], np.int64)
            before = np.cumsum(flat) - flat
            counts = np.diff(inner)
            # Parts of the rests that are cut, then rests that are whole.
            row = np.concatenate((np.repeat(np.flatnonzero(cut), counts), np.flatnonzero(~cut)))
            at = np.concatenate((before - np.repeat(before[inner[:-1]], counts) if len(flat) else flat, np.zeros(int((~cut).sum()), np.int64)))
            size = np.concatenate((flat, length[~cut]))
            found, risen = windows(size, capacity)
            if each == 1 or risen <= max(1, len(found) // 100):
                break
            each //= 2
        own = np.concatenate((block["cut_crcs"].filter(pa.array(cut)).combine_chunks().flatten().to_numpy(zero_copy_only=False), crc[~cut]))
        order = np.array([k for members in found for k in sorted(members)], np.int64)
        window = np.repeat(np.arange(len(found)), [len(m) for m in found])
        ends = np.cumsum(size[order])
        opens = np.concatenate(([0], ends[:-1]))
        offset = opens - opens[np.searchsorted(window, window, "left")]
        at_row = row[order]
        columns = [pa.array(piece[at_row]), pa.array(doc[at_row], mask=missing[at_row]), *map(pa.array, (start[at_row] + at[order], size[order], own[order], total[at_row], 2 * (number * _WINDOWS + window), offset))]
        return pa.table(columns, names=["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pieces(df: DataFrame, text: str = "text", ident: str = "doc_id", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Each document's ids in full windows and a rest: (doc_id, start, length, ids_crc32, doc_tokens, cut_crcs); the last are
    the digests of the rest's graded parts, null for a full window. ids: with the ids themselves, as little-endian 32-bit integers."""
    import public_tokenizers

    docs = df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_cut(path or public_tokenizers.path("word_bpe_49k.json"), window, end_id, ids), _PIECES + ", ids binary" * ids)


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with the sequence and the place in it of each; cut: a written table of pieces with their number (piece)."""
    full = cut.where("cut_crcs is null").select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut.where("cut_crcs is not null").select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut_crcs")
    blocks = max(1, round((rests.agg(F.sum("length")).first()[0] or 0) / BLOCK))
    dealt = rests.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    return full.unionByName(dealt.groupBy("block").applyInArrow(_pack(window), _PLACED))


def pack_documents(df: DataFrame, ids: bool = False, window: int = WINDOW, **options) -> tuple[DataFrame, DataFrame]:
    """(packed, cut): the packed pieces of df's documents, and the table in the shared folder that they were cut into."""
    scratch = Scratch(df.sparkSession)
    cut = scratch.stash(pieces(df, ids=ids, window=window, **options).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return pack(cut, window), cut


def sequences(packed: DataFrame, cut: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, n_tokens, doc_ids, starts): the sequences' ids, from a table of pieces with ids; starts are
    the places where a piece begins."""
    whole = cut.select("piece", F.col("start").alias("from"), "ids")
    own = packed.join(whole, "piece").select("sequence_id", "offset", "doc_id", F.substring("ids", (4 * (F.col("start") - F.col("from")) + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"))
    # At most a window of ids meet.
    held = own.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return held.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")).withColumn("n_tokens", F.octet_length("ids") / 4)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("piece")
