"""Five-word shingles as 64-bit hashes, HyperMinHash registers and their bands, in numpy.

Words are hashed by BLAKE2, so that no pattern of letters makes two words alike; a set is known by 128 bits of BLAKE2
over its sorted hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WIDTH = 5
BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
#: A text is cut into words in pieces of about so many bytes; and shingles go on in groups of about so many.
PIECE, GROUP = 1 << 21, 1 << 17
#: Words whose hashes are remembered, and the longest of them in bytes.
MOST_KNOWN, LONGEST_KNOWN = 100_000, 48

_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random order of the buckets for each bucket: an empty bucket takes the register of the first filled one in its order.
_ORDER = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1).argsort(axis=1).astype(np.uint16)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[word] = value
        return value


_known = _Known()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z as a-z; a long text is cut at white space, so that few words are held at once."""
    parts, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = space.end() if space else len(text)
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of a text, sorted; with fewer than WIDTH words the whole sequence is the only one."""
    words = word_hashes(text)
    if len(words) >= WIDTH:
        n = len(words) - WIDTH + 1
        mixed = words[:n] * _PLACE[0]
        for k in range(1, WIDTH):
            mixed += words[k : k + n] * _PLACE[k]
        hashes = _mix(mixed)
        hashes.sort()
        return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]
    if len(words):
        return _mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(words)))
    return words


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of the set's digest."""
    both = blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def grouped(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of runs of texts with about GROUP shingles; a null text has no shingles."""
    first, sets, held = 0, [], 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        sets.append(shingle_set(value.as_py() or b""))
        held += len(sets[-1])
        if held >= GROUP:
            yield first, sets
            first, sets, held = i + 1, [], 0
    if sets:
        yield first, sets


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash: for each bucket the smallest hash as leading zeros and mantissa bits; 0: empty."""
    n = len(offsets) - 1
    out = np.zeros(n * REGISTERS, np.uint16)
    if not len(hashes):
        return out.reshape(n, REGISTERS)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    slot = doc * REGISTERS + (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    new = np.concatenate(([True], slot[1:] != slot[:-1]))  # hashes are sorted: the first of a bucket is its smallest
    least = (hashes[new] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    # frexp is exact for 53 bits: the low bits are cleared first, so that nothing is rounded up.
    zeros = 64 - np.frexp((least & ~np.uint64(0x7FF) | np.uint64(0x400)).astype(np.float64))[1]
    zeros = np.minimum(zeros, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out[slot[new]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | (np.uint64((1 << MANTISSA_BITS) - 1) - mantissa)
    return out.reshape(n, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[float, float]:
    """Jaccard estimate from two rows of registers, chance collisions taken off; and its standard error at 0.75."""
    used = np.count_nonzero(a | b)
    if not used:
        return 0.0, 1.0
    same = np.count_nonzero((a == b) & (a > 0))
    ratio = size_a / max(size_b, 1)
    by_chance = 0.169919487159739 * REGISTERS / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return max(0.0, same - by_chance) / used, float(np.sqrt(0.75 * 0.25 / used))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers, empty registers filled from others first."""
    filled = regs.copy()
    for i in np.flatnonzero((regs == 0).any(axis=1) & (regs > 0).any(axis=1)):
        have, lack = np.flatnonzero(regs[i]), np.flatnonzero(regs[i] == 0)
        filled[i, lack] = regs[i, have[_ORDER[lack][:, have].argmin(axis=1)]]
    bands = filled[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND_ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k] + np.uint64(1))
    return key
