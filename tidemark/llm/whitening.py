"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Two passes over the vectors give exact sums and the scatter of the centred vectors, as partial sums of each task. The
factor L of the scatter A = L L^T is small. Rotations from the right make its columns orthogonal, L V = U S: the squared
norms of the rotated columns are the eigenvalues of A, and the columns of length 1 its eigenvectors. Nothing is squared
on the way, which keeps small eigenvalues right. A third pass measures the covariance of the whitened vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

COMPONENTS = 32
#: an entry c is taken as the whole number floor(SCALE c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: entries are whole numbers below this in size, which doubles hold exactly
LARGEST = 2**52
#: rows of a batch that are turned into matrices at once
ROWS = 4_096
LONGEST = 2**63 - 1


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column a component
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off first, so no digit is lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sums)^2, exact; None where it doesn't fit a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        off = x - whole
        most = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if most < 2**62 and most**2 * len(self.sums) < LONGEST:
            return ((self.n * off - rest) ** 2).sum(1).tolist()
        exact = (sum((self.n * o - r) ** 2 for o, r in zip(row, rest.tolist())) for row in off.tolist())
        return [d if d <= LONGEST else None for d in exact]


def pivoted_cholesky(a: np.ndarray, eps: float = np.finfo(float).eps) -> np.ndarray:
    """L with L L^T = a, a column for each step of numerical rank; each step takes the largest diagonal that is left."""
    a, n = np.array(a, float), len(a)
    left, columns = a.diagonal().copy(), []
    floor = eps * n * left.max(initial=0)
    done = np.zeros(n, bool)
    while not done.all():
        at = int(np.where(done, -1.0, left).argmax())
        if left[at] <= floor:
            break
        column = a[:, at].copy()
        for c in columns:
            column -= c * c[at]
        column[done] = 0
        column /= np.sqrt(left[at])
        columns.append(column)
        done[at] = True
        left -= column**2
    return np.stack(columns, 1) if columns else np.zeros((n, 0))


def one_sided_jacobi(factor: np.ndarray, eps: float = np.finfo(float).eps, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of factor factor^T, by falling value.

    A sweep meets all pairs of columns in rounds of disjoint pairs, as a round robin does.
    """
    g = factor.copy()
    k = g.shape[1]
    ring = list(range(k + k % 2))
    for _ in range(sweeps if k > 1 else 0):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(p, q) for p, q in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :])) if p < k and q < k]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs).T
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            act = np.abs(gamma) > 4 * eps * np.sqrt(alpha * beta)
            if not act.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(act, 2 * gamma, 1)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(act, t, 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, g[:, order] / norms[order]


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """df, without rows whose vector is null or holds an entry that is null, not finite or too large, with `_x`, the entries as whole numbers, and their number `_size`.

    Rows whose vector is empty go too.
    """
    entry = F.col(vector).cast("array<double>")
    fits = F.forall(entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * SCALE < LARGEST - SHIFT), F.lit(False)))
    kept = df.filter(F.col(vector).isNotNull() & fits & (F.size(vector) > 0))
    return kept.withColumns({"_x": F.transform(entry, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT), "_size": F.size(vector)})


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.column(0).slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sums of the vectors of the commonest length, of several the least.

    Sums are made of parts of 26 bits, exact and without overflow.
    """
    commonest = rows.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_size").first()
    if commonest is None:
        return 0, []
    size = commonest["_size"]

    def count(batches):
        total = [0] * size
        for x in _matrices(batches, size):
            high, low = (x >> 26).sum(0).tolist(), (x & (2**26 - 1)).sum(0).tolist()
            total = [t + (h << 26) + w for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t >> 32 for t in total], pa.int64()), pa.array([t & (2**32 - 1) for t in total], pa.int64())], ["i", "high", "low"])

    parts = rows.filter(F.col("_size") == size).select("_x").mapInArrow(count, "i int, high bigint, low bigint")
    found = parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()  # a row a dimension
    return commonest.n, [(r.high << 32) + r.low for r in found]


def products(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum of of(x)^T of(x) over all rows: a matrix of each task, added up in Spark."""

    def multiply(batches):
        total = None
        for x in _matrices(batches, size):
            y = of(x)
            part = y.T @ y
            total = part if total is None else total + part
        if total is not None:
            k = len(total)
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    found = rows.filter(F.col("_size") == size).select("_x").mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # a row a pair of dimensions
    k = max((r.j for r in found), default=-1) + 1
    out = np.zeros((k, k))
    for r in found:
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """rows: from whole_vectors."""
    n, total = sums(rows)
    model = Whitening(n, total, np.zeros(0), np.zeros((len(total), 0)), 0.0)
    if n:
        scatter = products(rows, len(total), model.centred)
        values, vectors = one_sided_jacobi(pivoted_cholesky(scatter))
        model.values, model.vectors, model.trace = values[:components] / n, vectors[:, :components], float(scatter.trace()) / n
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not len(model.values):
        return None
    found = products(rows, len(model.sums), model.project) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(rows: DataFrame, model: Whitening, *columns: str) -> DataFrame:
    """The columns, deviation and whitened, an array with a number for each component, of each row of whole_vectors.

    Rows of another length than the model's are left out.
    """
    size, kept = len(model.sums), rows.select("_x", "_size", *columns)
    types = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                w = model.project(x)
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                arrays = [*part.columns[1:], pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "deviation", "whitened"])

    return kept.filter(F.col("_size") == size).drop("_size").mapInArrow(run, f"{types}, deviation bigint, whitened array<double>")


def whitened(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, Whitening, float | None]:
    """(rows, model, identity_error): key, deviation and the whitened vector of each row of df that has a usable vector.

    Left out are null and empty vectors, entries that are null, not finite or of about 7e13 and more, and vectors of
    another length than the commonest (of several the least). There are as many components as the vectors have
    independent directions, at most `components`: none for an empty table, a single row or equal rows. Rows that repeat
    count as often as they are there; null keys are kept, other columns are ignored. Equal eigenvalues have some
    orthogonal vectors of their space. The driver holds a matrix of the vectors' length squared. deviation is null
    where it does not fit a long.
    """
    rows = whole_vectors(df.select(F.col(key), F.col(vector)), vector)
    model = fit(rows, components)
    return whiten(rows, model, key), model, identity_error(rows, model)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitened(table(spark, sf_dir, "embeddings"))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
