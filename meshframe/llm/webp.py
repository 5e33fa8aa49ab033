"""Lossless WebP (VP8L) images, written and read in numpy.

The reader takes what the format allows: canonical prefix codes (simple and normal), back-references with the
two-dimensional distance map, the colour cache, meta prefix codes, and the predictor, cross-colour, subtract-green and
colour-indexing transforms. Streams with one group of prefix codes and no cache are read fast: the token that would
start at every bit is looked up at once, the chain of tokens is followed, and only then are values fetched.

The writer takes the transforms, back-references (of any length, or long ones alone, which are found in numpy) and the
cache as asked for. It writes one group of codes.
"""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import groupby

import numpy as np

CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MOST_SIDE = 1 << 14
#: Bits of the longest code that is written (15 may be read): short tables are quicker.
CODE_LIMIT = 12
#: Bits that are looked up at once.
BLOCK_BITS = 1 << 21
#: Back-references of the quick writer: the shortest, the longest and the farthest.
LONG, LONGEST, FARTHEST = 32, 4096, (1 << 20) - 120
#: Bits of a back-reference and of the codes that it adds, about; and the share of an image that back-references must save.
JUMP_BITS, CODE_BITS, SAVED = 32, 120, 0.1
_ODD = np.random.default_rng(7).integers(1, 1 << 63, LONG // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EIGHT = np.arange(8, dtype=np.uint64)
_REVERSED = ((np.arange(1 << 15)[:, None] >> np.arange(15) & 1) << np.arange(14, -1, -1)).sum(1).astype(np.uint32)


def _near_distances() -> list[tuple[int, int]]:
    """The offsets of distance codes 1 to 120, as the format orders them: rows 0 to 7 above, columns 8 to the left to 7
    to the right, by Euclidean distance, at equal distance the row further up first, then the column further left.
    """
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    near.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
    return near


# ---------------------------------------------------------------- bits


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, shift = divmod(self.at, 8)
        value = int.from_bytes(self.data[first : first + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1)
        self.at += n
        return value


class BitWriter:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._v: list[int] = []
        self._n: list[int] = []

    def put(self, value: int, n: int) -> None:
        self._v.append(value)
        self._n.append(n)

    def put_pairs(self, values: list[int], sizes: list[int]) -> None:
        self._v += values
        self._n += sizes

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Fields of at most 32 bits each."""
        self._flush()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def _flush(self) -> None:
        if self._v:
            self.values.append(np.array(self._v, np.uint64))
            self.sizes.append(np.array(self._n, np.int64))
            self._v, self._n = [], []

    def bytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        start = ends - sizes
        words = np.zeros(int(ends[-1] // 32) + 2, np.uint64)
        word, shift = start >> 5, (start & 31).astype(np.uint64)
        shifted = values << shift
        # Fields come in order, so those of a word are neighbours: they are added up in one pass.
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sums = np.add.reduceat(shifted, first)
        np.add.at(words, word[first], sums & np.uint64(0xFFFFFFFF))
        np.add.at(words, word[first] + 1, sums >> np.uint64(32))
        return words.astype("<u4").tobytes()[: int(-(-ends[-1] // 8))]


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts, limit: int) -> list[int]:
    """Huffman code lengths of at most limit bits; one symbol alone gets length 1."""
    counts = np.asarray(counts)
    symbols = np.flatnonzero(counts).tolist()
    weights = counts[symbols].tolist()
    lengths = [0] * len(counts)
    n = len(symbols)
    if n == 1:
        lengths[symbols[0]] = 1
    if n < 2:
        return lengths
    floor = 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            (v, i), (w, j) = heapq.heappop(heap), heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (v + w, node))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= limit:
            for s, d in zip(symbols, depth[:n], strict=True):
                lengths[s] = d
            return lengths
        floor *= 2  # rarer symbols are taken for commoner ones until the tree is low enough


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used symbols in canonical order, and their lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def canonical(lengths) -> np.ndarray:
    """The codes, each with its first bit lowest, as they stand in the stream."""
    lengths = np.asarray(lengths, np.int64)
    codes = np.zeros(len(lengths), np.uint32)
    used, own = _in_order(lengths)
    share = 1 << (15 - own)
    codes[used] = _REVERSED[np.cumsum(share) - share]  # as fractions of 15 bits, codes follow each other without a gap
    return codes


@lru_cache(maxsize=16)
def _read_order(bits: int) -> np.ndarray:
    return _REVERSED[: 1 << bits] >> np.uint32(15 - bits)


class Code:
    """A prefix code as a table over the next max_bits bits: symbol and length."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used, own = _in_order(lengths)
        if len(used) <= 1:
            self.bits = 0
            self.symbol, self.length = np.zeros(1, np.uint16), np.zeros(1, np.uint8)
            self.symbol[:] = used
        else:
            self.bits = int(own[-1])
            order, times = _read_order(self.bits), 1 << (self.bits - own)
            if times.sum() != len(order):
                raise ValueError("the prefix code is not complete")
            self.symbol = np.repeat(used.astype(np.uint16), times)[order]
            self.length = np.repeat(own.astype(np.uint8), times)[order]
        self.refers = bool((self.symbol >= 256).any())

    def read(self, bits: Bits) -> int:
        at = bits.read(self.bits) if self.bits else 0
        bits.at -= self.bits - int(self.length[at])
        return int(self.symbol[at])


@lru_cache(maxsize=256)
def _single(symbol: int) -> Code:
    return Code([0] * symbol + [1])


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return _single(first)
        lengths = [0] * alphabet
        lengths[first] = lengths[bits.read(8)] = 1
        return Code(lengths)
    lengths = [0] * alphabet
    meta = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        meta[k] = bits.read(3)
    code = Code(meta)
    most = alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    # All that the lengths can take (14 bits each) as one number.
    ahead, at = int.from_bytes(bits.data[bits.at // 8 : bits.at // 8 + 2 * alphabet + 16], "little") >> bits.at % 8, 0
    symbols, sizes, mask = code.symbol.tolist(), code.length.tolist(), (1 << code.bits) - 1
    i, before = 0, 8
    while i < alphabet and most:
        most -= 1
        here = ahead >> at & 0x3FFF
        s = symbols[here & mask]
        at += sizes[here & mask]
        if s < 16:
            lengths[i] = s
            before = s or before
            i += 1
            continue
        here >>= sizes[here & mask]
        value, again, used = (before, 3 + (here & 3), 2) if s == 16 else (0, 3 + (here & 7), 3) if s == 17 else (0, 11 + (here & 127), 7)
        at += used
        lengths[i : i + again] = [value] * again
        i += again
    bits.at += at
    return Code(lengths[:alphabet])


def _write_code(out: BitWriter, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n] if any(lengths) else []
    if len(used) <= 2 and all(i < 256 for i in used):
        first = used[0] if used else 0
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    for value, same in groupby(lengths):
        run = len(list(same))
        if value:
            tokens.append((value, 0, 0))
            run -= 1
            while run >= 3:
                n = min(6, run)
                tokens.append((16, n - 3, 2))
                run -= n
        else:
            while run >= 3:
                n = min(138, run)
                tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
                run -= n
        if run:
            tokens += [(value, 0, 0)] * run
    meta = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    out.put(0, 1)
    last = max(k for k in range(19) if meta[CODE_LENGTH_ORDER[k]] or k < 4)
    out.put(last + 1 - 4, 4)
    for k in CODE_LENGTH_ORDER[: last + 1]:
        out.put(meta[k], 3)
    out.put(0, 1)  # lengths of the whole alphabet follow
    codes, sizes = canonical(meta).tolist(), meta if sum(1 for n in meta if n) > 1 else [0] * 19
    # Extra bits stand behind the code they belong to.
    out.put_pairs([codes[s] | extra << sizes[s] if sizes[s] else extra for s, extra, _ in tokens], [sizes[s] + n for s, _, n in tokens])


def _prefix_values(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and number of extra bits of length and distance symbols."""
    s = symbols.astype(np.int64)
    extra = np.where(s < 4, 0, (s - 2) >> 1)
    base = np.where(s < 4, s + 1, ((2 + (s & 1)) << np.maximum(extra, 0)) + 1)
    return base, extra


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    n = high - 1
    symbol = 2 * high + (v >> n & 1)
    return symbol, v & ((1 << n) - 1), n


# ---------------------------------------------------------------- reading


def _div_up(a: int, bits: int) -> int:
    return (a + (1 << bits) - 1) >> bits


_NEAR = _near_distances()


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = _NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, meta_bits = None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _read_image(bits, _div_up(width, meta_bits), _div_up(height, meta_bits), False)
        groups_at = (meta.reshape(-1, _div_up(width, meta_bits)) >> 8) & 0xFFFF
    n_groups = int(groups_at.max()) + 1 if groups_at is not None else 1
    green = 256 + LENGTH_SYMBOLS + ((1 << cache_bits) if cache_bits else 0)
    groups = [[_read_code(bits, a) for a in (green, 256, 256, 256, DISTANCE_SYMBOLS)] for _ in range(n_groups)]
    if groups_at is None and not cache_bits:
        return _read_fast(bits, groups[0], width, height)
    return _read_slow(bits, groups, groups_at, meta_bits, cache_bits, width, height)


def _read_slow(bits: Bits, groups, groups_at, meta_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    n, at, entered = width * height, 0, 0
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    while at < n:
        if groups_at is None:
            group = groups[0]
        else:
            y, x = divmod(at, width)
            group = groups[int(groups_at[y >> meta_bits, x >> meta_bits])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_SYMBOLS:
            length = _value(bits, s - 256)
            far = _distance(_value(bits, group[4].read(bits)), width)
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - far]
                at += 1
        else:
            while entered < at:
                cache[(0x1E35A7BD * out[entered] & 0xFFFFFFFF) >> shift] = out[entered]
                entered += 1
            out[at] = cache[s - 256 - LENGTH_SYMBOLS]
            at += 1
    return np.array(out, np.uint32)


def _value(bits: Bits, symbol: int) -> int:
    base, extra = _prefix_values(np.array([symbol]))
    return int(base[0]) + (bits.read(int(extra[0])) if extra[0] else 0)


def _read_fast(bits: Bits, group: list[Code], width: int, height: int) -> np.ndarray:
    """One group and no cache: a token's meaning depends on the bit it starts at alone."""
    n = width * height
    green, red, blue, alpha, distance = group
    if not (red.bits or blue.bits or alpha.bits):
        rest = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
        if not green.bits and green.symbol[0] < 256:
            return np.full(n, rest | int(green.symbol[0]) << 8, np.uint32)
        return _read_green(bits, green, distance, width, n).astype(np.uint32) << np.uint32(8) | np.uint32(rest)
    tokens: list[np.ndarray] = []
    jumps: list[tuple[int, int, int, int]] = []  # literals before it, pixels before it, length, distance
    literals = made = 0
    while made < n:
        window = _window(bits.data, bits.at, BLOCK_BITS + 64, green.refers)
        size, spans = _token_sizes(window, group)
        own: list[int] = []
        add, p, last = own.append, 0, min(BLOCK_BITS, len(window) - 1)
        while p < last and made < n:
            span = spans.get(p)
            if span is None:
                add(p)
                made += 1
            else:
                jumps.append((literals + len(own), made, span[0], _distance(span[1], width)))
                made += span[0]
            p += size[p]
        if not p:
            raise ValueError("the data end early")
        tokens.append(_literals(window, np.array(own, np.int64), green, red, blue, alpha))
        literals += len(own)
        bits.at += p
    pixels = tokens[0] if len(tokens) == 1 else np.concatenate(tokens)
    if made != n:
        raise ValueError("a back-reference leaves the image")
    out = np.zeros(n, np.uint32)
    taken = at = 0
    for before, place, length, far in jumps:
        out[at:place] = pixels[taken:before]
        _copy(out, place, length, far)
        taken, at = before, place + length
    out[at:] = pixels[taken:]
    return out


def _copy(out: np.ndarray, place: int, length: int, far: int) -> None:
    """Repeats what stands far before place; a copy that overlaps itself doubles."""
    if far > place or place + length > len(out):
        raise ValueError("a back-reference leaves the image")
    done = 0
    while done < length:
        step = min(length - done, far + done)
        out[place + done : place + done + step] = out[place - far : place - far + step]
        done += step


def _read_green(bits: Bits, green: Code, distance: Code, width: int, n: int) -> np.ndarray:
    """The green bytes of n pixels whose other channels take no bits."""
    out, made = np.empty(n, np.uint8), 0
    kind = green.length | (green.symbol >= 256).astype(np.uint8) << np.uint8(7)
    mask = np.uint32((1 << green.bits) - 1)
    while made < n:
        here = _window(bits.data, bits.at, BLOCK_BITS + 64, False) & mask
        size = kind[here]
        back = np.flatnonzero(size >= 128) if green.refers else np.zeros(0, np.int64)
        if len(back):
            length, code, size[back] = _references(bits.data, bits.at, back, green, distance, here)
        end = min(BLOCK_BITS, 8 * len(bits.data) - bits.at)
        if end <= 0:
            raise ValueError("the data end early")
        where = _follow(size, end)
        counts = None
        if len(back):
            jumps = np.flatnonzero(kind[here[where]] >= 128)
            which = np.searchsorted(back, where[jumps])
            counts = np.ones(len(where), np.int64)
            counts[jumps] = length[which]
            ends = np.cumsum(counts)
            used = min(len(where), int(np.searchsorted(ends, n - made)) + 1)
        else:
            used = min(len(where), n - made)
        last = int(where[used - 1])
        bits.at += last + int(size[last])
        if counts is None:
            out[made : made + used] = green.symbol[here[where[:used]]]
            made += used
            continue
        starts = made + ends[:used] - counts[:used]
        plain = np.ones(used, bool)
        jumps, which = jumps[jumps < used], which[: np.count_nonzero(jumps < used)]
        plain[jumps] = False
        if made + int(ends[used - 1]) > n:
            raise ValueError("a back-reference leaves the image")
        out[starts[plain]] = green.symbol[here[where[:used][plain]]]
        for place, k in zip(starts[jumps].tolist(), which.tolist(), strict=True):
            _copy(out, place, int(length[k]), _distance(int(code[k]), width))
        made += int(ends[used - 1])
    return out


def _references(data: bytes, start: int, back: np.ndarray, green: Code, distance: Code, here: np.ndarray):
    """(lengths, distance codes, bits taken) of the back-references that would begin at the places in back."""
    raw = np.frombuffer(data[start // 8 :] + b"\0" * 24, np.uint8)
    last = len(raw) - 8

    def ahead(place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits from each place on; 32 at most."""
        at = place + start % 8
        first = np.minimum(at >> 3, last)
        words = raw[first[:, None] + np.arange(8)].view("<u8").reshape(-1)
        return (words >> (at & 7).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    base, extra = _prefix_values(green.symbol[here[back]] - np.uint16(256))
    p = back + green.length[here[back]]
    length = base + ahead(p, extra)
    p = p + extra
    found = ahead(p, np.full(len(p), distance.bits))
    p = p + distance.length[found]
    base, extra = _prefix_values(distance.symbol[found])
    code = base + ahead(p, extra)
    return length, code, (p + extra - back).astype(np.uint8)


def _follow(size: np.ndarray, end: int) -> np.ndarray:
    """The places of tokens, one behind the other, from place 0 up to end. Only every fourth is walked to."""
    place = np.arange(len(size), dtype=np.int32)
    two = size + size.take(place + size, mode="clip")
    four = (two + two.take(place + two, mode="clip")).tobytes()  # a token has 15 + 10 + 15 + 18 bits at most
    own: list[int] = []
    add, p = own.append, 0
    while p < end:
        add(p)
        p += four[p]
    first = np.array(own, np.int32)
    third = first + two[first]
    out = np.empty((len(first), 4), np.int32)
    out[:, 0], out[:, 2] = first, third
    out[:, 1] = first + size[first]
    out[:, 3] = third + size.take(third, mode="clip")
    out = out.reshape(-1)
    return out[: int(np.searchsorted(out, end))]


def _window(data: bytes, start: int, most: int, wide: bool) -> np.ndarray:
    """For each bit from start on, the bits that follow (32 if wide, else 17 at least); zeros behind the end."""
    first = start // 8
    raw = np.frombuffer(data[first : first + most // 8 + 8] + b"\0" * 16, np.uint8)
    n, kind = len(raw) - 7, np.uint64 if wide else np.uint32
    words = raw[:n].astype(kind)
    for k in range(1, 5 if wide else 3):
        words |= raw[k : n + k].astype(kind) << kind(8 * k)
    bits = (words[:, None] >> _EIGHT.astype(kind)).reshape(-1)[start % 8 :]
    return bits.astype(np.uint32) if wide else bits


def _token_sizes(window: np.ndarray, group: list[Code]):
    """The bits of the token that would start at each place, and the back-references among them: (length, code)."""
    green, red, blue, alpha, distance = group
    here = window & np.uint32((1 << green.bits) - 1)
    size = green.length[here]
    limit = len(window) - 1

    def look(code: Code, at):
        found = window[at] & np.uint32((1 << code.bits) - 1)
        return code.symbol[found], code.length[found]

    if red.bits or blue.bits or alpha.bits:
        place, size = np.arange(len(window)), size.astype(np.int64)
        for code in (red, blue, alpha):
            if code.bits:
                size += look(code, np.minimum(place + size, limit))[1]
    if not green.refers:
        return size.astype(np.uint8).tobytes(), {}
    symbol = green.symbol[here]
    back = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_SYMBOLS))
    base, extra = _prefix_values(symbol[back] - np.uint16(256))
    p = np.minimum(back + green.length[here[back]], limit)
    length = base + (window[p] & ((1 << extra) - 1).astype(np.uint32))
    p = np.minimum(p + extra, limit)
    d, used = look(distance, p)
    p = np.minimum(p + used, limit)
    base, extra = _prefix_values(d)
    code = base + (window[p] & ((1 << extra) - 1).astype(np.uint32))
    size = size.astype(np.int64)
    size[back] = p + extra - back
    return size.tolist(), dict(zip(back.tolist(), zip(length.tolist(), code.tolist(), strict=True), strict=True))


def _literals(window, where, green, red, blue, alpha) -> np.ndarray:
    here = window[where] & np.uint32((1 << green.bits) - 1)
    out = green.symbol[here].astype(np.uint32) << np.uint32(8)
    at = where + green.length[here]
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if code.bits:
            here = window[at] & np.uint32((1 << code.bits) - 1)
            out |= code.symbol[here].astype(np.uint32) << np.uint32(shift)
            at = at + code.length[here]
        else:
            out |= np.uint32(int(code.symbol[0]) << shift)
    return out


# ---------------------------------------------------------------- transforms


def _split(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _join(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts, np.uint8).view("<u4").reshape(parts.shape[:-1])


def _predict(mode: int, left, top, top_left, top_right):
    """Predictions from neighbours given as integer arrays (..., 4)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        out = np.zeros_like(top)
        out[..., 3] = 255
        return out
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = half(left, top)
    return np.clip(mean + ((mean - top_left) / 2).astype(np.int64), 0, 255)


def _neighbours(image: np.ndarray, y: int, x: int):
    """As integer arrays; right of a row's end stands the row's own first pixel."""
    width = image.shape[1]
    right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
    return image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], right


def _mode_at(modes: np.ndarray, y: int, x: int, bits: int) -> int:
    return int(modes[y >> bits, x >> bits] >> 8) & 15


def predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds the predictions to residuals (inverse), or takes them off pixels."""
    source = _split(pixels).astype(np.int64)
    height, width = pixels.shape
    whole = source.copy() if not inverse else np.zeros_like(source)
    out = np.zeros_like(source)
    kinds = np.unique((modes >> 8) & 15)
    if len(kinds) == 1 and kinds[0] in (1, 2):  # from the left, or from above, all over: running sums or differences
        first, then = (0, 1) if kinds[0] == 1 else (1, 0)
        if inverse:
            source[0, 0, 3] += 255
            edge = (slice(None), 0) if kinds[0] == 1 else (0, slice(None))
            source[edge] = np.cumsum(source[edge], axis=0)
            return _join((np.cumsum(source, axis=then) & 255).astype(np.uint8))
        out = source.copy()
        edge = (slice(1, None), 0) if first == 0 else (0, slice(1, None))
        before = (slice(None, -1), 0) if first == 0 else (0, slice(None, -1))
        if then == 1:
            out[:, 1:] -= source[:, :-1]
        else:
            out[1:] -= source[:-1]
        out[edge] = source[edge] - source[before]
        out[0, 0, 3] -= 255
        return _join((out & 255).astype(np.uint8))
    for y in range(height):
        for x in range(width):
            if not y:
                guess = np.array([0, 0, 0, 255]) if not x else whole[y, x - 1]
            elif not x:
                guess = whole[y - 1, 0]
            else:
                guess = _predict(_mode_at(modes, y, x, bits), *_neighbours(whole, y, x))
            if inverse:
                whole[y, x] = (source[y, x] + guess) & 255
            else:
                out[y, x] = (source[y, x] - guess) & 255
    return _join((whole if inverse else out).astype(np.uint8))


def cross_colour(pixels: np.ndarray, table: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    parts = _split(pixels).astype(np.int64)
    y, x = np.indices(pixels.shape)
    t = _split(table)[y >> bits, x >> bits].view(np.int8).astype(np.int64)
    green_to_red, green_to_blue, red_to_blue = t[..., 0], t[..., 1], t[..., 2]
    signed = lambda v: ((v & 255) ^ 128) - 128
    green, red, blue = signed(parts[..., 1]), parts[..., 2], parts[..., 0]
    way = 1 if inverse else -1
    new_red = (red + way * (green_to_red * green >> 5)) & 255
    true_red = signed(new_red if inverse else red)
    parts[..., 0] = (blue + way * (green_to_blue * green >> 5) + way * (red_to_blue * true_red >> 5)) & 255
    parts[..., 2] = new_red
    return _join(parts.astype(np.uint8))


def subtract_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    parts = _split(pixels).copy()
    for k in (0, 2):
        parts[..., k] += parts[..., 1] if inverse else np.uint8(0) - parts[..., 1]
    return _join(parts)


def _pack_bits(colours: int) -> int:
    """log2 of the pixels that share one index pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---------------------------------------------------------------- container


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) of a WebP file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.at += 1
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, here = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            table = _read_image(bits, _div_up(here, b), _div_up(height, b), False).reshape(_div_up(height, b), -1)
            transforms.append((kind, here, b, table))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_split(_read_image(bits, n, 1, False)).astype(np.int64), axis=0) & 255
            b = _pack_bits(n)
            transforms.append((kind, here, b, _join(table.astype(np.uint8))))
            here = _div_up(here, b)
        else:
            transforms.append((kind, here, 0, None))
    pixels = _read_image(bits, here, height, True).reshape(height, here)
    for kind, here, b, table in reversed(transforms):
        if kind == PREDICTOR:
            pixels = predictor(pixels, table, b, True)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, table, b, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            index = pixels >> 8 & 255
            if b:
                step = 8 >> b
                index = (index[..., None] >> (np.arange(1 << b, dtype=np.uint32) * np.uint32(step)) & ((1 << step) - 1)).reshape(height, -1)[:, :here]
            pixels = np.append(table, np.zeros(256, np.uint32)).astype(np.uint32)[index]
    return pixels


def _tokens(pixels: np.ndarray, width: int, refs: bool, cache_bits: int):
    """Literals, cache hits and back-references: columns (kind, value, length, distance code)."""
    flat = pixels.reshape(-1)
    if not refs and not cache_bits:
        return None
    out, at, n = [], 0, len(flat)
    seen: dict[bytes, int] = {}
    values, raw = flat.tolist(), flat.astype("<u4").tobytes()
    cache, shift = [None] * (1 << cache_bits), 32 - cache_bits
    codes = _codes_of_distances(width)
    while at < n:
        length = far = 0
        if refs:
            key = raw[4 * at : 4 * at + 16]
            before = seen.get(key)
            if at and values[at - 1] == values[at]:
                before = at - 1 if before is None else before
            if before is not None and at - before <= (1 << 20) - 120:
                while at + length < n and length < 4096 and values[before + length] == values[at + length]:
                    length += 1
                far = at - before
        if length >= 4:
            out.append((2, 0, length, codes.get(far, far + 120)))
            step = length
        else:
            slot = (0x1E35A7BD * values[at] & 0xFFFFFFFF) >> shift if cache_bits else 0
            out.append((1, slot, 0, 0) if cache_bits and cache[slot] == values[at] else (0, values[at], 0, 0))
            step = 1
        for p in range(at, at + step):
            if refs:
                seen[raw[4 * p : 4 * p + 16]] = p
            if cache_bits:
                cache[(0x1E35A7BD * values[p] & 0xFFFFFFFF) >> shift] = values[p]
        at += step
    return out


def repeats(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, how far back) of stretches of LONG bytes and more that stood before, from left to right.

    Hashes of LONG bytes at every LONGth place are kept; those of all places are looked up among them.
    """
    n = len(samples) - LONG + 1
    if n <= 1:
        return []
    raw = np.ascontiguousarray(samples, np.uint8).tobytes()
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    hashes = eight[:n] * _ODD[0]
    for k in range(1, LONG // 8):
        hashes += eight[8 * k : 8 * k + n] * _ODD[k]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _ODD[0]
    kept, first = np.unique(hashes[::LONG], return_index=True)
    shift = np.uint64(64 - max(10, len(kept).bit_length() + 4))
    maybe = np.zeros(1 << (64 - int(shift)), bool)
    maybe[kept >> shift] = True
    at = np.flatnonzero(maybe[hashes >> shift])
    which = np.minimum(np.searchsorted(kept, hashes[at]), len(kept) - 1)
    source = first[which] * LONG
    fine = (kept[which] == hashes[at]) & (source < at) & (at - source < FARTHEST)
    out, end, size = [], 0, len(raw)
    for place, start in zip(at[fine].tolist(), source[fine].tolist(), strict=True):
        if place < end or raw[place : place + LONG] != raw[start : start + LONG]:
            continue
        length, step = LONG, 64
        while place + length < size:
            if raw[place + length : place + length + step] == raw[start + length : start + length + step] and place + length + step <= size:
                length += step
                step *= 2
            elif step > 1:
                step //= 2
            else:
                break
        while place > end and start > 0 and raw[place - 1] == raw[start - 1]:
            place, start, length = place - 1, start - 1, length + 1
        end = place + length
        while length:  # a last part too short for a token of its own is taken off the one before
            part = length if length <= LONGEST else min(LONGEST, length - LONG)
            out.append((place, part, place - start))
            place, start, length = place + part, start + part, length - part
    return out


@lru_cache(maxsize=16)
def _codes_of_distances(width: int) -> dict[int, int]:
    return {_distance(code, width): code for code in range(120, 0, -1)}


def _write_green(out: BitWriter, samples: np.ndarray, rest: tuple[int, int, int], width: int, jumps: list[tuple[int, int, int]]) -> None:
    """Green bytes, the other channels (red, blue, alpha) being the same all over, with back-references."""
    codes = _codes_of_distances(width)
    own = [(_prefix_of(length), _prefix_of(codes.get(far, far + 120))) for _, length, far in jumps]
    ends = np.zeros(len(samples) + 1, np.int8)
    for place, length, _ in jumps:
        ends[place] += 1
        ends[place + length] -= 1
    plain = samples[np.cumsum(ends[:-1], dtype=np.int8) == 0]
    before = [place for place, _, _ in jumps]
    before = np.array(before, np.int64) - np.cumsum([0, *(length for _, length, _ in jumps[:-1])])
    counts = np.bincount(plain, minlength=256 + LENGTH_SYMBOLS)
    far_counts = np.zeros(DISTANCE_SYMBOLS, int)
    for (s, _, _), (d, _, _) in own:
        counts[256 + s] += 1
        far_counts[d] += 1
    lengths, far_lengths = code_lengths(counts, CODE_LIMIT), code_lengths(far_counts, CODE_LIMIT)
    _write_code(out, lengths)
    for value in rest:
        _write_code(out, [0] * value + [1])
    _write_code(out, far_lengths)
    codes_of, far_codes, alone = canonical(lengths), canonical(far_lengths), np.count_nonzero(far_counts) == 1
    fields = [((int(codes_of[256 + s]), lengths[256 + s]), (x, n), (int(far_codes[d]), 0 if alone else far_lengths[d]), (y, m)) for (s, x, n), (d, y, m) in own]
    fields = np.array(fields, np.int64).reshape(-1, 2)
    fields[fields[:, 1] == 0, 0] = 0
    literal = np.ones(len(plain) + len(fields), bool)
    literal[np.repeat(before, 4) + np.arange(len(fields))] = False
    both = np.empty((2, len(literal)), np.int64)
    both[:, literal] = codes_of[plain], np.array(lengths)[plain]
    both[:, ~literal] = fields.T
    out.put_many(*both)


def _write_image(out: BitWriter, pixels: np.ndarray, main: bool, refs: bool | str = False, cache_bits: int = 0) -> None:
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    alphabet = 256 + LENGTH_SYMBOLS + ((1 << cache_bits) if cache_bits else 0)
    width = pixels.shape[-1]
    parts = _split(pixels.reshape(-1))
    if refs == "long":
        jumps = [] if ((pixels ^ pixels.flat[0]) & np.uint32(0xFFFF00FF)).any() else repeats(parts[:, 1])
        if jumps and _saved(parts[:, 1], jumps) > SAVED:
            _write_green(out, parts[:, 1], tuple(int(parts[0, k]) for k in (2, 0, 3)), width, jumps)
            return
        refs = False
    tokens = _tokens(pixels, width, refs, cache_bits)
    if tokens is None:
        fields = []
        for k, size in ((1, alphabet), (2, 256), (0, 256), (3, 256)):
            if k != 1 and not (parts[:, k] != parts[0, k]).any():
                _write_code(out, [0] * int(parts[0, k]) + [1])
                continue
            counts = np.bincount(parts[:, k], minlength=size)
            lengths = code_lengths(counts, CODE_LIMIT)
            _write_code(out, lengths)
            if np.count_nonzero(counts) > 1:
                fields.append((canonical(lengths)[parts[:, k]], np.array(lengths)[parts[:, k]]))
        _write_code(out, [0] * DISTANCE_SYMBOLS)
        if len(fields) == 1:
            out.put_many(*fields[0])
        elif fields:
            out.put_many(np.stack([f[0] for f in fields], 1).reshape(-1), np.stack([f[1] for f in fields], 1).reshape(-1))
        return
    counts = [np.zeros(a, int) for a in (alphabet, 256, 256, 256, DISTANCE_SYMBOLS)]
    rows = []
    for kind, value, length, code in tokens:
        if kind == 0:
            row = [(0, value >> 8 & 255), (1, value >> 16 & 255), (2, value & 255), (3, value >> 24)]
        elif kind == 1:
            row = [(0, 256 + LENGTH_SYMBOLS + value)]
        else:
            s, extra, n = _prefix_of(length)
            d, d_extra, d_n = _prefix_of(code)
            row = [(0, 256 + s), (None, extra, n), (4, d), (None, d_extra, d_n)]
        rows.append(row)
        for field in row:
            if field[0] is not None:
                counts[field[0]][field[1]] += 1
    lengths = [code_lengths(c, CODE_LIMIT) for c in counts]
    for n in lengths:
        _write_code(out, n)
    codes, single = [canonical(n) for n in lengths], [sum(1 for x in n if x) < 2 for n in lengths]
    for row in rows:
        for field in row:
            if field[0] is None:
                if field[2]:
                    out.put(field[1], field[2])
            elif not single[field[0]]:
                out.put(int(codes[field[0]][field[1]]), lengths[field[0]][field[1]])


def _saved(samples: np.ndarray, jumps: list[tuple[int, int, int]]) -> float:
    """The share of the literals' bits that back-references save, about."""
    bits = _entropy(samples)
    taken = sum(length for _, length, _ in jumps)
    return (taken * bits - len(jumps) * JUMP_BITS - CODE_BITS) / max(1.0, len(samples) * bits)


def _entropy(samples: np.ndarray) -> float:
    """Bits a sample."""
    counts = np.bincount(samples, minlength=256)
    shares = counts[counts > 0] / len(samples)
    return float(-(shares * np.log2(shares)).sum())


def encode(pixels: np.ndarray, transforms=(), refs: bool | str = False, cache_bits: int = 0, tile_bits: int = 4, modes=None, cross=None) -> bytes:
    """A WebP file of ARGB pixels (height, width), with the transforms in the order given.

    refs: back-references of 4 pixels and more, or "long": of LONG and more, where green alone varies and they pay.
    modes: predictor modes by tile (mode 1 everywhere by default); cross: cross-colour multipliers by tile, as pixels.
    """
    height, width = pixels.shape
    out = BitWriter()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((pixels >> 24 != 255).any())), 1)
    out.put(0, 3)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        tiles = (_div_up(height, tile_bits), _div_up(pixels.shape[1], tile_bits))
        if kind == PREDICTOR:
            table = np.asarray(modes if modes is not None else np.full(tiles, 1), np.uint32) << 8 | np.uint32(0xFF000000)
            out.put(tile_bits - 2, 3)
            _write_image(out, table, False)
            pixels = predictor(pixels, table, tile_bits, False)
        elif kind == CROSS_COLOUR:
            table = np.asarray(cross if cross is not None else np.full(tiles, 0x00102030), np.uint32)
            out.put(tile_bits - 2, 3)
            _write_image(out, table, False)
            pixels = cross_colour(pixels, table, tile_bits, False)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            index = index.reshape(pixels.shape).astype(np.uint32)
            steps = _split(colours)
            steps = np.concatenate((steps[:1], steps[1:] - steps[:-1]))
            out.put(len(colours) - 1, 8)
            _write_image(out, _join(steps).reshape(1, -1), False)
            b = _pack_bits(len(colours))
            if b:
                wide = _div_up(index.shape[1], b) << b
                index = np.pad(index, ((0, 0), (0, wide - index.shape[1]))).reshape(height, -1, 1 << b)
                index = (index << (np.arange(1 << b, dtype=np.uint32) * np.uint32(8 >> b))).sum(-1, dtype=np.uint32)
            pixels = index << np.uint32(8) | np.uint32(0xFF000000)
    out.put(0, 1)
    _write_image(out, pixels, True, refs, cache_bits)
    body = b"\x2f" + out.bytes()
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded
