"""Whitening of embeddings by an exact scatter matrix in residue numbers.

Entries become integers, x = floor(1024 * c) + 100000. Every task multiplies its vectors with themselves modulo several
primes: residues are below 2**20, so a block of 8192 rows is summed by an ordinary double matrix product without any
rounding. Spark adds the residues of all tasks; as the primes' product exceeds twice the largest sum that counts and
magnitudes allow, Chinese remaindering gives the exact sums S and products X'X, whatever the order of the additions. From
them the exact covariance, n * X'X - S S' over n squared, is rounded once to double, and its unit eigenvectors (eigh)
are the components, by falling eigenvalue; of either sign the one whose largest entry is positive.

Rows whose vector is null, or holds null, NaN or an infinite entry, are left out, as are empty vectors. The dimension is
the commonest length (of several, the longest); vectors of other lengths, which have no place in one matrix, are left out
too. An entry beyond 2**61 counts as that. A null identifier is kept. Repeated rows count as often as they stand
there. A component without variance, as in a table of one vector, has whitened values 0 and explained 0, and counts for
nothing in identity_error. deviation is null where it exceeds a long, deviation_exact has it up to 38 digits. Other columns
are not looked at. An empty table gives no rows. What reaches the driver is a matrix of dimension + 1 rows for each prime.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, table, tasks_for

#: x = floor(SCALE * c) + SHIFT; the largest magnitude of x; components.
SCALE, SHIFT, MOST, COMPONENTS = 1024, 100_000, 1 << 61, 8
#: Residues have so many bits; so many rows are multiplied at once, that 2**BITS squared times them is below 2**53.
BITS, BLOCK = 20, 8192
#: Rows for each task that sums residues; each gives a matrix for each prime.
ROWS_EACH = 100_000
#: An eigenvalue below this share of the largest is no variance.
NOTHING = 1e-13


def primes(beyond: int) -> list[int]:
    """Primes below 2**BITS, from the largest on, until their product is above a number."""
    out, product, p = [], 1, 1 << BITS
    while product <= beyond:
        p -= 1
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def integers(c: np.ndarray) -> np.ndarray:
    """The integers of entries."""
    return np.clip(np.floor(c * SCALE), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors without nulls as rows of doubles."""
    return np.asarray(column.flatten()).astype(np.float64, copy=False).reshape(-1, dimension)


def residues(dimension: int, moduli: list[int]):
    """(prime, i, j, r): the products of a task's vectors with themselves and with 1, modulo each prime; i <= j."""
    size = dimension + 1
    upper = np.triu_indices(size)

    def run(batches):
        sums = np.zeros((len(moduli), size, size), np.int64)
        for batch in batches:
            x = integers(matrix(batch.column("embedding"), dimension))
            for first in range(0, len(x), BLOCK):
                block = x[first : first + BLOCK]
                for k, p in enumerate(moduli):
                    r = np.ones((len(block), size))
                    r[:, :dimension] = block % p
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        for k in range(len(moduli)):
            if sums[k].any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(sums[k][upper])], names=["prime", "i", "j", "r"])

    return run


@dataclass(frozen=True)
class Fit:
    """n vectors with sums, covariance, and components as columns, by falling eigenvalues."""

    n: int
    dimension: int
    largest: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return self.eigenvalues / total if total > 0 else np.zeros(len(self.eigenvalues))

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by: one over the deviation, 0 without variance."""
        varies = self.eigenvalues > NOTHING * max(float(self.eigenvalues.max(initial=0.0)), 0.0)
        return np.where(varies, 1 / np.sqrt(np.where(varies, self.eigenvalues, 1.0)), 0.0)


def remainder(found: list[int], moduli: list[int]) -> int:
    """The number of least magnitude that leaves these remainders."""
    whole, value = math.prod(moduli), 0
    for r, p in zip(found, moduli, strict=True):
        other = whole // p
        value += r * other * pow(other, -1, p)
    value %= whole
    return value - whole if 2 * value > whole else value


def clean(df: DataFrame, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(vec_id, embedding of doubles) of the rows whose vector is whole."""
    rows = df.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(whole, F.lit(False)) & (F.size("embedding") > 0))


def measured(rows: DataFrame) -> tuple[int, int, int]:
    """Of clean rows: how many have the commonest length, that length, and the largest |x| among them."""
    most = F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))))
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), most.alias("most"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return 0, 0, 0
    return found["n"], found["d"], min(MOST, math.ceil(SCALE * found["most"]) + 1) + SHIFT


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Sums, covariance and components of df's vectors; None if there are none."""
    rows = clean(df, vector, vector)
    n, dimension, largest = measured(rows)
    if not n:
        return None
    rows = rows.where(F.size("embedding") == dimension)
    moduli = primes(2 * n * max(largest, 1) ** 2)
    parts = rows.select("embedding").coalesce(tasks_for(df.sparkSession, n, ROWS_EACH)).mapInArrow(residues(dimension, moduli), "prime int, i int, j int, r long")
    sums = parts.groupBy("prime", "i", "j").agg(F.sum("r").alias("r"))
    size = dimension + 1
    found = np.zeros((len(moduli), size, size), np.int64)
    for prime, i, j, r in sums.toPandas().itertuples(index=False):
        found[prime, i, j] = found[prime, j, i] = r % moduli[prime]
    exact = [[remainder([int(found[k, i, j]) for k in range(len(moduli))], moduli) if i <= j else 0 for j in range(size)] for i in range(size)]
    total = [exact[i][dimension] for i in range(dimension)]
    if exact[dimension][dimension] != n:
        raise RuntimeError("the vectors changed between two readings")
    covariance = np.zeros((dimension, dimension))
    for i in range(dimension):
        for j in range(i, dimension):
            covariance[i, j] = covariance[j, i] = (n * exact[i][j] - total[i] * total[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Fit(n, dimension, largest, total, covariance, np.maximum(values[order], 0.0), vectors)


def centred(x: np.ndarray, fitted: Fit) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python's integers where a long might not hold it."""
    if 2 * fitted.n * fitted.largest < 1 << 63:
        return x * fitted.n - np.array(fitted.sums, np.int64)
    return x.astype(object) * fitted.n - np.array(fitted.sums, object)


def _whiten(fitted: Fit):
    turn = fitted.components * fitted.scales

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            away = centred(integers(matrix(batch.column("embedding"), fitted.dimension)), fitted)
            if away.dtype == object or int(np.abs(away).max()) ** 2 * fitted.dimension >= 1 << 63:
                away = away.astype(object)
            exact = (away * away).sum(1).tolist()
            white = (away.astype(np.float64) / fitted.n) @ turn
            deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            long = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, long, lists], names=["vec_id", "deviation", "deviation_exact", "whitened"])

    return run


def transform(df: DataFrame, fitted: Fit, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened array<double>) of df's usable vectors of the fitted dimension."""
    rows = clean(df, vector, ident).where(F.size("embedding") == fitted.dimension)
    kind = df.schema[ident].dataType.simpleString()
    return rows.mapInArrow(_whiten(fitted), f"vec_id {kind}, deviation long, deviation_exact decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components that vary."""
    live = [i for i, s in enumerate(fitted.scales) if s > 0]
    if not live:
        return 0.0
    w = {i: F.get("whitened", F.lit(i)) for i in live}
    means = white.agg(*[F.avg(w[i]) for i in live]).first()
    away = {i: w[i] - F.lit(float(m)) for i, m in zip(live, means, strict=True)}
    pairs = [(i, j) for i in live for j in live if i <= j]
    found = white.agg(*[F.avg(away[i] * away[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = fit(vectors)
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    scratch = Scratch(spark)
    white = scratch.stash(transform(vectors, fitted), "white")
    error = identity_error(white, fitted)
    parts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.get("whitened", F.lit(k)).alias("whitened"), F.lit(float(e)).alias("explained")) for k, e in enumerate(fitted.explained)])
    rows = white.select("vec_id", "deviation", "deviation_exact", F.explode(parts).alias("p"))
    return rows.select("vec_id", "p.component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(float(error)).alias("identity_error"), "deviation_exact")
