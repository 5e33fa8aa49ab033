"""Document quality by ridge regression on random Fourier features, calibrated by isotonic regression.

A document becomes a short vector of statistics (kinds of characters, words, repetition). Cosines of random projections
of the standardised vector approximate a Gaussian kernel. Partitions of the training rows sum their normal equations;
the sums (one small matrix a partition, of a bounded number of partitions) are added and solved on the driver. Scores
of training rows that were left out of the fit give the isotonic calibration.

Nulls: a null text is empty; an empty text has a vector of its own and a score like any other. The training rows are a
bounded sample (MOST_ROWS for each label), in at most FIT_PARTITIONS partitions. Without rows of both labels every score
is the share of good rows. Ties: training rows of one score are pooled, so that a score has one calibrated value; equal
texts get equal scores. A very long text is read whole; its words are held at once. Repeated rows get a result each.
Columns other than text and identifier are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, is_held_out, table
from meshframe.llm.labelled import training_rows

THRESHOLD = 0.7
MOST_ROWS, FIT_PARTITIONS = 8000, 16
FEATURES, RIDGE, SEED = 384, 1e-3, 5
#: The Gaussian kernel's width, as a multiple of the square root of the number of statistics.
WIDTH = 0.7

_MARKS = b"%*#&$|!?.,;:-_/\\<>(){}[]\"'=+@~^`"
_GROUPS = np.zeros((256, 8 + len(_MARKS)))
_GROUPS[65:91, 0] = _GROUPS[97:123, 1] = _GROUPS[48:58, 2] = 1
_GROUPS[32, 3] = _GROUPS[10, 4] = 1
_GROUPS[[9, 11, 12, 13], 5] = 1
_GROUPS[128:192, 6] = _GROUPS[192:, 7] = 1
for _i, _c in enumerate(_MARKS):
    _GROUPS[_c, 8 + _i] = 1


def statistics(text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = counts / max(1, len(raw))
    used = shares[shares > 0]
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    half = len(words) // 2
    return [
        *np.sqrt(shares @ _GROUPS).tolist(),
        float(-(used * np.log(used)).sum()) / 6,
        math.log1p(len(words)) / 10,
        len(text) / n / 20 if words else 0.0,
        len(distinct) / n,
        len(distinct) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(lines)) / 5,
        len(distinct.intersection(words[half:], words[:half])) / max(1, len(distinct)) if half else 0.0,
        max(map(len, words), default=0) ** 0.5 / 10,
        float(not words),
    ]


class Kernel:
    """z -> cosines; fit and score are of standardised statistics."""

    def __init__(self, mean, scale, width: float = WIDTH, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.directions = rng.standard_normal((len(self.mean), features)) / (width * math.sqrt(len(self.mean)))
        self.phases = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: (scores, probabilities) to interpolate between, each pool smoothed by half a row.

    Rows of one score are one pool from the start.
    """
    distinct, which = np.unique(scores, return_inverse=True)
    sums, sizes = np.bincount(which, y, len(distinct)), np.bincount(which, minlength=len(distinct)).astype(float)
    pools: list[list[float]] = []
    for s, v, n in zip(distinct.tolist(), sums.tolist(), sizes.tolist(), strict=True):
        pools.append([v, n, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, _, high = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = high
    xs = np.array([p[k] for p in pools for k in (2, 3)])
    ps = np.repeat([(p[0] + 0.5) / (p[1] + 1) for p in pools], 2)
    return xs, np.maximum.accumulate(ps)


def _vectors(batches):
    for batch in batches:
        x = [statistics(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _equations(kernel: Kernel):
    def run(batches):
        left, right = 0.0, 0.0
        for batch in batches:
            if len(batch):
                z = kernel(np.array(batch.column("x").to_pylist()))
                left, right = left + z.T @ z, right + z.T @ np.asarray(batch.column("label"), float)
        if not isinstance(left, float):
            yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["left", "right"])

    return run


class Model:
    def __init__(self, kernel: Kernel | None, weights, xs, ps):
        self.kernel, self.weights, self.xs, self.ps = kernel, weights, xs, ps

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), self.ps[0])
        return np.interp(self.kernel(x) @ self.weights, self.xs, self.ps)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, ridge: float = RIDGE) -> Model:
    scratch = Scratch(docs.sparkSession)
    try:
        return _fitted(training_rows(docs, labels, F.col("quality"), {0: most, 1: most}), ridge, scratch)
    finally:
        scratch.remove()


def _fitted(rows: DataFrame, ridge: float, scratch: Scratch) -> Model:
    vectors = scratch.stash(rows.mapInArrow(_vectors, "doc_id long, label int, x array<double>"), "quality").coalesce(FIT_PARTITIONS)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    fit, rest = vectors.where(~fold), vectors.where(fold)
    counts = dict(fit.groupBy("label").count().collect())
    if len(counts) < 2:
        return Model(None, None, None, [(counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)])
    moments = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).orderBy("i").collect()
    kernel = Kernel([m["mean"] for m in moments], [max(m["scale"], 1e-3) for m in moments])
    sums = fit.select("label", "x").mapInArrow(_equations(kernel), "left binary, right binary").collect()
    size = FEATURES + 1
    left = sum(np.frombuffer(r["left"]).reshape(size, size) for r in sums)
    right = sum(np.frombuffer(r["right"]) for r in sums)
    weights = np.linalg.solve(left + ridge * sum(counts.values()) / size * np.eye(size), right)
    judged = rest.select("label", "x").toArrow()
    if not len(judged):
        judged = fit.select("label", "x").toArrow()
    xs, ps = isotonic(kernel(np.array(judged["x"].to_pylist())) @ weights, np.array(judged["label"].to_pylist(), float))
    return Model(kernel, weights, xs, ps)


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                x = np.array([statistics(t.as_py() or "") for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.score(x))], names=["doc_id", "score"])

    return run


def quality(df: DataFrame, model: Model, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
