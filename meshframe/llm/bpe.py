"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the last token of the prefix's encoding is unique: of the tokens that end the prefix,
it is the one that the encoding of what comes before can stand beside, that is, the pair of the two last tokens encodes
to itself. So an encoding is a chain of last tokens, one stored for each prefix: appending bytes only adds entries, and
after an edit the entries before it hold; those behind it are computed again until the chains agree.

Texts are cut into pieces by the tokenizer's pattern. Pieces and their chains are kept in bounded tables per process,
so each distinct piece is computed once. Token files are read on the driver and broadcast.

A null text is empty: no ids. Any Unicode text will do; lone surrogates cannot come out of Spark. Repeated rows get a
result each; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import table

#: Entries of a process's tables at most; a table that is full is emptied, but for the words of the moment.
MOST_WORDS, MOST_PIECES, MOST_PAIRS, LONGEST_KEPT = 150_000, 200_000, 200_000, 64
#: Texts are encoded together up to so many characters.
TOGETHER = 3_000_000
#: Marks that, behind letters, are a piece of their own.
MARKS = ".,;:!?%*#&$|"
#: White_Space in Unicode; "\s" of Python's engines also takes U+001C to U+001F.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def exact_pattern(pattern: str) -> str:
    r"""The pattern with \s spelt out, inside and outside of brackets."""
    out, inside = [], False
    for part in re.findall(r"\\.|\[|\]|.", pattern):
        inside = part == "[" or inside and part != "]"
        if part == r"\s":
            part = SPACES if inside else f"[{SPACES}]"
        elif part == r"\S":
            part = f"[^{SPACES}]"
        out.append(part)
    return "".join(out)


class Pieces:
    """Cuts texts into words that no piece crosses, and words into the pattern's pieces."""

    def __init__(self, pattern: str):
        self.pieces = regex.compile(exact_pattern(pattern)).findall

    def words_of(self, text: str) -> list[str]:
        """Cuts before every space that stands before a non-space: a piece never goes on across such a place."""
        if not text:
            return []
        first, *rest = text.split(" ") if not _ODD(text) else _CUT(text)
        words = [" " + w for w in rest]
        return [first, *words] if first else words

    def split_word(self, word: str) -> list[str]:
        """The pieces of a stretch of text that no piece crosses."""
        start = word[:1] == " "
        if word[start:].isalpha():
            return [word]
        core = word.rstrip(MARKS)
        if core[start:].isalpha():  # letters, then marks: two pieces, as the pattern has it
            return [core, word[len(core) :]]
        return self.pieces(word)


class PrefixEncoder(Pieces):
    """Encodes pieces of bytes by the ranks; keeps the last token of each prefix it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        # Every suffix of a token, with its rank or -1: what does not end a token need not be made longer.
        self.ends = {token[i:]: -1 for token in ranks for i in range(len(token))} | ranks
        self.sizes = [len(b) for b in self.bytes]
        self.singles = [ranks[bytes([i])] for i in range(256)]
        self.split = self._split_table()
        super().__init__(pattern)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _split_table(self) -> list[tuple[int, int] | None]:
        """The two tokens that merge into each token; None for a byte.

        The merge that makes a token joins the encodings that its bytes have under lower ranks only, so the last merge
        is found by running the merges of lower rank on the token's bytes.
        """
        out: list[tuple[int, int] | None] = [None] * len(self.bytes)
        ranks = self.ranks
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = [bytes([b]) for b in token]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                out[rank] = (ranks[parts[0]], ranks[parts[1]])
        return out

    def stand(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, encode to themselves.

        Walks back through the merges that made the two: no merge across the border may come before both sides' own.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        ranks, text, split, limit = self.ranks, self.bytes, self.split, 1 << 60
        a, b = left, right
        while True:
            across = ranks.get(text[a] + text[b], 1 << 60)
            if across < limit:
                answer = False
                break
            halves_a, halves_b = split[a], split[b]
            if halves_a is None and halves_b is None:
                answer = True
                break
            # Undo the later of the two merges: what lies across had to wait for it. Merges of equal rank run from the
            # left, so across must beat a's merge, but not be above b's.
            if halves_b is None or halves_a is not None and a > b:
                limit, a = a, halves_a[1]
            else:
                limit, b = b + 1, halves_b[0]
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def last_token(self, piece: bytes, end: int, chain: list[int]) -> int:
        """The last token of piece[:end]; chain holds those of all shorter prefixes."""
        ends, found, n = self.ends, [], 1
        while n <= end:
            token = ends.get(piece[end - n : end])
            if token is None:
                break
            if token >= 0:
                found.append((n, token))
            n += 1
        for n, token in reversed(found):
            if n == end or self.stand(chain[end - n], token):
                return token
        raise ValueError("no token ends the prefix: the ranks lack single bytes")

    def chains(self, pieces: list[bytes]):
        """For each piece, in sorted order, its chain: for each prefix the last token (entry 0: the empty prefix).

        Sorted pieces share prefixes with the one before; what a piece adds is appended. The list is used again.
        """
        chain, before = [0], b""
        ranks, sizes, pairs, stand, singles = self.ranks, self.sizes, self.pairs, self.stand, self.singles
        for piece in pieces:
            same, most = 0, min(len(piece), len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del chain[same + 1 :]
            for end in range(same + 1, len(piece) + 1):
                # Only one token is valid, so the likely ones are tried first: the last one with the new byte, and the
                # new byte alone.
                if end > 1:
                    last = chain[end - 1]
                    start = end - 1 - sizes[last]
                    token = ranks.get(piece[start:end])
                    if token is not None:
                        key = chain[start] << 20 | token
                        if not start or (pairs[key] if key in pairs else stand(chain[start], token)):
                            chain.append(token)
                            continue
                    token = singles[piece[end - 1]]
                    key = last << 20 | token
                    if pairs[key] if key in pairs else stand(last, token):
                        chain.append(token)
                        continue
                chain.append(self.last_token(piece, end, chain))
            before = piece
            yield chain

    def follow(self, chain: list[int]) -> list[int]:
        """The encoding that a chain stands for."""
        out, end, text = [], len(chain) - 1, self.bytes
        while end:
            out.append(chain[end])
            end -= len(text[chain[end]])
        return out[::-1]

    def learn(self, pieces: set[str], known: dict[str, tuple[int, ...]]) -> None:
        """Puts the encodings of pieces into known."""
        hard = []
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = (whole,)
            else:
                hard.append(raw)
        hard.sort()
        for raw, chain in zip(hard, self.chains(hard), strict=True):
            known[raw.decode()] = tuple(self.follow(chain))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        lists = [self.words_of(t) for t in texts]
        words, known = self.words, self.known
        here = set().union(*lists)
        new = here.difference(words)
        if len(words) + len(new) > MOST_WORDS:  # the words that occur here too are the ones that will again
            words = self.words = {w: words[w] for w in here.intersection(words)}
        split = {w: self.split_word(w) for w in new}
        pieces = set().union(*split.values())
        missing = pieces.difference(known)
        if len(known) + len(missing) > MOST_PIECES:
            known.clear()
            missing = pieces
        self.learn(missing, known)
        for w, p in split.items():
            words[w] = known[p[0]] if len(p) == 1 else tuple(i for x in p for i in known[x])
        out = []
        for own in lists:
            ids: list[int] = []
            for word in own:
                ids += words[word]
            out.append(ids)
        for piece in [p for p in missing if len(p) > LONGEST_KEPT]:
            del known[piece]
        for word in [w for w in new if len(w) > LONGEST_KEPT]:
            del words[word]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


#: A space before white space or the end, where a plain split would cut wrongly.
_ODD = re.compile(rf" (?=[{SPACES}]|\Z)").search
_CUT = re.compile(rf" (?=[^{SPACES}])").split


class Chain:
    """A piece's bytes with its chain of last tokens, to append to and to edit."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece, self.chain = encoder, bytearray(), [0]
        self.append(piece)

    def _next(self) -> int:
        near = bytes(self.piece[-self.encoder.longest - 1 :])  # a byte more than a token has: it isn't all, unless it is
        return self.encoder.last_token(near, len(near), self.chain[-len(near) :])

    def append(self, more: bytes) -> None:
        for b in more:
            self.piece.append(b)
            self.chain.append(self._next())

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of piece[start:end]; returns how many entries were computed again.

        Behind the edit, entries are as before once the longest token's number of consecutive entries has come out the
        same: every later entry depends on no more than those.
        """
        tail, old = bytes(self.piece[end:]), self.chain[end + 1 :]
        del self.piece[start:], self.chain[start + 1 :]
        self.append(new)
        done, same = len(new), 0
        for i, b in enumerate(tail):
            self.piece.append(b)
            self.chain.append(self._next())
            done += 1
            same = same + 1 if self.chain[-1] == old[i] and len(self.encoder.bytes[old[i]]) <= same + 1 else 0
            if same >= self.encoder.longest:
                self.piece += tail[i + 1 :]
                self.chain += old[i + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        return self.encoder.follow(self.chain)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path), pattern)


def in_groups(batch: pa.RecordBatch, most: int = TOGETHER):
    """Slices of a batch with their texts: about so many characters each."""
    texts, first, size = [], 0, 0
    for i, text in enumerate(batch.column("text")):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield batch.slice(first, i + 1 - first), texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield batch.slice(first), texts


def _digests(path: str, pattern: str):
    def run(batches):
        encoder = _encoder(path, pattern)
        names = [str(i) for i in range(len(encoder.bytes))]
        for batch in batches:
            for part, texts in in_groups(batch):
                counts, digests, decoded = [], [], []
                for tokens in encoder.encode_many(texts):
                    counts.append(len(tokens))
                    digests.append(hashlib.sha256(" ".join(map(names.__getitem__, tokens)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(tokens)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part, texts in in_groups(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder.encode_many(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _tokenizer(path, pattern):
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_documents(df: DataFrame, text: str = "text", ident: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row. The file must be where every executor can read it."""
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_ids(*_tokenizer(path, pattern)), "doc_id long, ids array<int>")


def digest_documents(df: DataFrame, text: str = "text", ident: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row."""
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_digests(*_tokenizer(path, pattern)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
