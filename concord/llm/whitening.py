"""Embedding whitening (operator 12): weighted multiplicity covariance, each distinct vector whitened once, joined back.

Entries become whole numbers, x = floor(64 * c) + 1000000, so equal vectors can be grouped exactly and sums are exact.

1. Rows are grouped by x; a group's count is its weight. Partial counts meet in the shuffle, so a vector that holds a
   third of the rows is one row of each task.
2. Exact sums give the mean. The covariance is a weighted, centred matrix product: a task multiplies its batches and
   returns one matrix, and the matrices are added by a grouped sum. The vectors are centred before they are multiplied.
   Covariances may also count each distinct vector once (``multiplicity=False``).
3. The driver takes eigenvectors of one matrix of MAX_DIM x MAX_DIM at most.
4. Each distinct x is whitened once, with its exact deviation, and written; the covariance of what was written against the
   identity gives identity_error.
5. Rows get the result by a join on the whole vector, with its hash beside it for sorting; Spark splits a hot vector.

Defined results: vectors that are null, empty, of another length than most (the longer of equally frequent lengths), or
hold null or non-finite entries, or entries of 2^46 or more in size, which are no whole numbers in a double, take no part.
Rows without a vec_id and repeated rows count and are returned like others. Directions whose eigenvalue is below RANK of
the largest have no spread to divide by and are not returned; so a table of equal vectors, one row or no row gives no rows.
deviation is null where it is beyond a long. A common length above MAX_DIM is refused. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import table, written

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 46)
COMPONENTS, MAX_DIM, RANK = 32, 2048, 1e-9
LOW = 26  # sums are kept in two parts, the lower one of so many bits
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """n vectors with sums (whole numbers), projections (dimension, component), which divide by sqrt(eigenvalue), and
    the share of variance of each component."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole number next to each mean, and what n times the mean has beyond n times that."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near, strict=True)], dtype=np.int64)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0).where(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    if d > MAX_DIM:
        raise ValueError(f"vectors have {d} entries; at most {MAX_DIM} are whitened")
    return rows.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the matrices whose rows (i, row) the tasks returned."""
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((cells.i.max() + 1, cells.j.max() + 1), cells.v.dtype)
    out[cells.i, cells.j] = cells.v
    return out


def sums(distinct: DataFrame, weight: str) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, w = _matrix(batch.column("x"), "int64"), batch.column(weight).to_numpy(zero_copy_only=False)
            if len(x):
                got = np.stack([np.r_[w @ (x >> LOW), w.sum()], np.r_[w @ (x & ((1 << LOW) - 1)), 0]])
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], ["i", "row"])

    high, low = _added(distinct.select("x", weight).mapInArrow(run, "i int, row array<long>"))
    return int(high[-1]), [(int(a) << LOW) + int(b) for a, b in zip(high[:-1], low[:-1], strict=True)]


def covariance(distinct: DataFrame, column: str, weight: str, near: np.ndarray | None = None, beyond: np.ndarray | None = None) -> np.ndarray:
    """Weighted covariance, divisor the sum of weights, of ``column``, centred on ``near`` + ``beyond`` before multiplying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v, w = _matrix(batch.column(column), "float64" if near is None else "int64"), batch.column(weight).to_numpy(zero_copy_only=False)
            if len(v):
                v = v if near is None else (v - near) - beyond
                v = np.c_[v, np.ones(len(v))]
                got = (v * w[:, None]).T @ v
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    m = _added(distinct.select(column, weight).mapInArrow(run, "i int, row array<double>"))
    mean = m[:-1, -1] / m[-1, -1]
    return m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean)


def fit(distinct: DataFrame, components: int = COMPONENTS, multiplicity: bool = True) -> Fit | None:
    """``distinct``: x and w (its count). None where no direction has spread."""
    if distinct.isEmpty():
        return None
    distinct = distinct if multiplicity else distinct.withColumn("w", F.lit(1).cast("long"))
    n, s = sums(distinct, "w")
    near, rest = Fit(n, s, np.zeros((len(s), 0)), []).centre()
    v = covariance(distinct, "x", "w", near, rest / n)
    e, vectors = np.linalg.eigh((v + v.T) / 2)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    keep = (e > 0) & (e > RANK * e[0])
    if not keep.any():
        return None
    e, vectors = e[keep], vectors[:, keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(e))])
    return Fit(n, s, vectors * sign / np.sqrt(e), [float(x) for x in e / np.trace(v)])


def _deviations(x: np.ndarray, near: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2, exactly; None beyond a long."""
    off = x - near
    if (n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * x.shape[1] < 1 << 62:
        return ((n * off - rest) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in off]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(distinct: DataFrame, model: Fit) -> DataFrame:
    """x, w, deviation and z (array of double, by component) of each distinct vector."""
    near, rest = model.centre()
    shared = distinct.sparkSession.sparkContext.broadcast((model.n, near, rest, model.projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, near, rest, projection = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), "int64") if len(batch) else np.zeros((0, len(near)), np.int64)
            z = ((x - near) - rest / n) @ projection
            columns = [pa.array(_deviations(x, near, rest, n), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("w"), *columns], ["x", "w", "deviation", "z"])

    return distinct.select("x", "w").mapInArrow(run, "x array<long>, w long, deviation long, z array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each row that takes part and each component (OUT)."""
    rows = whole(vectors)
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "whitening")
    model = fit(distinct, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    each = written(whitened(distinct, model), "whitening")
    error = float(np.abs(covariance(each, "z", "w") - np.eye(len(model.explained))).max())
    hashed = F.xxhash64("x").alias("h")
    back = rows.select("vec_id", hashed, "x").join(each.select(hashed, "x", "deviation", "z"), ["h", "x"]).select("vec_id", "deviation",
        F.posexplode("z").alias("k", "whitened"))
    share = F.array(*map(F.lit, model.explained))
    return back.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "k").alias("explained"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": query}
ORACLES: dict[str, str] = {}
