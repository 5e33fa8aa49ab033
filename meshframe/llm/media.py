"""Media columns: bytes kept as lossless WebP images, read back and described by features.

A payload of n samples of 8 bits (a multiple of TILE = 24 * 24) stands in the green channel, row by row, 24 samples wide;
more than 16,384 rows take wider images, whose last row is filled up with transparent pixels, and what is more than an
image holds goes on in another (a stored form is the images' files one behind the other). Per image, few distinct bytes
take the palette transform, which puts several samples into a pixel; else the predictor (from the left, or from above) if
the entropy of what it leaves is lower by GAIN. Stretches that stood before are back-references where that is shorter.
The cache can't shorten an image of one channel, as an entry stands for one literal, and cross-colour has no other
channel to work on; the reader takes both.

Features of a picture: mean, deviation and entropy of the samples, and 64 bits that say which cells of an 8 by 8 grid are
above their median, as one string.

A null text is an empty one: one tile of bytes 255. Any bytes will do. A very long text is several images, one in memory at
a time, next to the text itself. Ties between forms go to the plainer one. Repeated rows get a result each. Columns other
than identifier and text are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import webp
from meshframe.llm.common import table

SIDE = 24
TILE = SIDE * SIDE
#: Up to so many distinct bytes the palette transform packs samples; and the bits a sample that the predictor must save.
FEW, GAIN = 16, 0.05
#: Bytes of an image, a multiple of TILE; and log2 of the side of the predictor's tiles, which all have one mode.
MOST_BYTES, MODE_BITS = 24 << 20, 9


def padded(raw: bytes, multiple: int = TILE) -> bytes:
    """Bytes 255 up to a positive multiple."""
    return raw + b"\xff" * (-len(raw) % multiple or (0 if raw else multiple))


def to_image(payload: bytes) -> np.ndarray:
    """(rows, width) ARGB pixels with the payload in green."""
    width = SIDE
    while -(-len(payload) // width) > webp.MOST_SIDE:
        width *= 2
    if width > webp.MOST_SIDE:
        raise ValueError("more bytes than an image holds")
    samples = np.frombuffer(payload, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    missing = -len(payload) % width
    return np.concatenate((samples, np.zeros(missing, np.uint32))).reshape(-1, width) if missing else samples.reshape(-1, width)


def from_image(pixels: np.ndarray) -> bytes:
    flat = pixels.reshape(-1)
    return (flat[flat >> 24 > 0] >> 8 & 255).astype(np.uint8).tobytes()


def _transforms(payload: bytes, height: int) -> tuple[tuple[int, ...], int]:
    """(transforms, predictor mode) for a payload that fills its image."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    if np.count_nonzero(counts) <= FEW:
        return (webp.PALETTE,), 0
    shares = counts[counts > 0] / len(samples)
    plain = float(-(shares * np.log2(shares)).sum())
    width = len(payload) // height
    left, above = (webp._entropy(samples[k:] - samples[:-k]) for k in (1, width))
    best, mode = min((left, 1), (above, 2))
    return ((webp.PREDICTOR,), mode) if best < plain - GAIN else ((), 0)


def store(payload: bytes) -> bytes:
    """The files of one image, or of as many as the payload needs."""
    out = []
    for first in range(0, max(1, len(payload)), MOST_BYTES):
        part = payload[first : first + MOST_BYTES]
        image = to_image(part)
        transforms, mode = _transforms(part, len(image)) if part and image[-1, -1] >> 24 > 0 else ((), 0)
        modes = np.full(tuple(-(-n // (1 << MODE_BITS)) for n in image.shape), mode) if mode else None
        out.append(webp.encode(image, transforms, "long", tile_bits=MODE_BITS, modes=modes))
    return b"".join(out)


def images(stored: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        yield webp.decode(stored[at:end] if at or end < len(stored) else stored)
        at = end


def load(stored: bytes) -> bytes:
    return b"".join(map(from_image, images(stored)))


def features(payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    shares = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    deviation = max(0.0, float(counts @ (values * values)) / len(samples) - mean * mean) ** 0.5
    rows = samples.reshape(-1, 8, SIDE // 8).sum(2, dtype=np.int64)
    edges = np.linspace(0, len(rows), 9).astype(int)
    cells = np.add.reduceat(rows, edges[:-1], axis=0) / np.diff(edges)[:, None]
    bits = int("".join("1" if b else "0" for b in (cells > np.median(cells)).reshape(-1)), 2)
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(shares * np.log2(shares)).sum()):.4f};grid={bits:016x}"


def _media(batches):
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            raw = (value.as_py() or "").encode()
            payload = padded(raw)
            stored = store(payload)
            back = load(stored)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])


def _stored(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([store(padded((v.as_py() or "").encode())) for v in batch.column("text")], pa.binary())], names=["doc_id", "media"])


def _pixels(batches):
    names = ["doc_id", "number", "height", "width", "argb"]
    for batch in batches:
        for i in range(len(batch)):
            stored = batch.column("media")[i].as_py()
            for number, pixels in enumerate([None] if stored is None else images(stored)):
                height, width = (None, None) if pixels is None else pixels.shape
                flat = None if pixels is None else pixels.astype("<u4").view(np.int32).reshape(-1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([number], pa.int32()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([flat], pa.list_(pa.int32()))], names=names)


def to_media(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, media binary): each text as a WebP file."""
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_stored, "doc_id long, media binary")


def to_pixels(media: DataFrame) -> DataFrame:
    """(doc_id, number, height, width, argb array<int>): the pixel arrays of WebP files, a row an image; nulls for a null
    file."""
    return media.select("doc_id", "media").mapInArrow(_pixels, "doc_id long, number int, height int, width int, argb array<int>")


def op3_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_media, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
