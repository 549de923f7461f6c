"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

Entries become whole numbers (64ths, shifted), so counts and sums over any number of rows are exact. The fit list,
each distinct vector once, is a distinct aggregation that combines before its shuffle and is written; two passes over
it give the sums and the centred scatter, both as small aggregates by dimension. The driver gets a matrix of dimension x
dimension, whatever the rows, and rotates pairs of dimensions until no off-diagonal entry is large beside its
diagonal ones, which keeps small eigenvalues accurate. A third pass measures the covariance of the whitened fit list
against the identity. The whitening matrix goes to the tasks with their function and every row is projected in place.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry go; so does an entry of which 64 times is beyond
2**45, whose sums no 64-bit number would hold. Vectors of another length than the most frequent one (among distinct vectors, the longer one
of equals) go as well. A component without variance (under 1e-12 of the largest) has null for `whitened` and stays out of
identity_error; a table without rows gives none; equal ids and null ids are rows of their own; a deviation beyond a long is
null; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldwork.llm.common import map_rows, written

#: An entry c is the whole number floor(STEPS * c) + SHIFT, as long as STEPS * |c| is at most MOST.
STEPS, SHIFT, MOST = 64, 1_000_000, 2.0**45
#: The part of the largest eigenvalue below which there is no variance.
NOTHING = 1e-12


def _batch_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows remain, their lengths, and their numbers end to end."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = STEPS * flat
        bad = ~(np.abs(scaled) <= MOST)
    at = np.concatenate(([0], np.cumsum(lengths)))
    wrong = np.concatenate(([0], np.cumsum(bad)))
    keep = valid & (wrong[at[1:]] == wrong[at[:-1]])
    return keep, lengths[keep], np.floor(scaled[np.repeat(keep, lengths)]).astype(np.int64) + SHIFT


def numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dims, x): the remaining rows, x being the vector's numbers as little-endian 64-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, lengths, x = _batch_numbers(batch.column(1))
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(8 * lengths))).astype(np.int32))
        body = pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends, pa.py_buffer(x.astype("<i8").tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(lengths, pa.int32()), body], names=["id", "dims", "x"])

    only = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return map_rows(only, run, "id long, dims int, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def _totals(fit: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(place, value): entry by entry the sum of `of` over all rows; of() makes a flat array of a block of rows, a task sends one sum an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), dims))
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([int(v) for v in total], pa.decimal128(38, 0)) if kind != "double" else pa.array(total, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["place", "value"])

    return fit.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric positive semidefinite matrix."""
    a, v = matrix.astype(float).copy(), np.eye(len(matrix))
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= 2.0**-53 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                tau = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q]] = turn.T @ a[[p, q]]
                a[p, q] = a[q, p] = 0.0
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass
class Whitening:
    """A fitted whitening: n fit vectors, their sums by dimension, and the leading eigenvalues and eigenvectors (columns)."""

    n: int
    dims: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        self.middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # the whole numbers next to the means
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.middle, strict=True)]
        self.some = self.values > NOTHING * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.middle, np.int64)) - np.array([float(Fraction(r, self.n)) for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components, NaN where there is no variance."""
        scale = np.full(len(self.values), np.nan)
        scale[self.some] = 1 / np.sqrt(self.values[self.some])
        return self.centred(x) @ self.vectors * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n x - S) squared."""
        near = x - np.array(self.middle, np.int64)
        if (self.n * (float(np.abs(near).max(initial=0)) + 1)) ** 2 * self.dims < 2.0**62:
            return ((self.n * near - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * c - r) ** 2 for c, r in zip(row, self.rest, strict=True)) for row in near.tolist()]
        return [f if f < 1 << 63 else None for f in found]


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on rows as numbers() gives them, each distinct vector once; None without rows."""
    fit = written(rows.select("dims", "x").distinct(), "fit-list")
    first = fit.groupBy("dims").agg(F.count("*").alias("n")).filter("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None
    dims, n = first["dims"], first["n"]
    fit = fit.filter(F.col("dims") == dims)

    def collected(of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
        return [r["value"] for r in _totals(fit, dims, of, kind).orderBy("place").collect()]  # dims, or dims squared, rows

    sums = [int(v) for v in collected(lambda x: x.sum(axis=0).astype(object), "decimal(38,0)")]
    blank = Whitening(n, dims, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    scatter = np.array(collected(lambda x: (lambda r: (r.T @ r).ravel())(blank.centred(x)), "double")).reshape(dims, dims) / n
    scatter = (scatter + scatter.T) / 2
    values, vectors = jacobi(scatter)
    out = Whitening(n, dims, sums, values[:components], vectors[:, :components], float(np.trace(scatter)))
    if out.some.any():
        k = int(out.some.sum())

        def moments(x: np.ndarray) -> np.ndarray:
            y = out.whitened(x)[:, out.some]
            return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

        got = np.array(collected(moments, "double")) / n
        mean, second = got[:k], got[k:].reshape(k, k)
        out.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return out


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every remaining row by every component, from 1."""
    rows = numbers(vectors, id_col, vector_col)
    model = fit_whitening(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    dims, k = model.dims, len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1), dims)
        m = len(x)
        columns = [
            pa.array(np.repeat(np.arange(m), k)), np.tile(np.arange(1, k + 1), m), np.full(m * k, model.n), model.deviation(x),
            model.whitened(x).ravel(), np.tile(explained, m), np.full(m * k, model.identity_error),
        ]
        place = columns[0]
        out = [batch.column(0).take(place), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()).take(place)]
        return pa.RecordBatch.from_arrays([*out, *(pa.array(c, pa.float64(), from_pandas=True) for c in columns[4:])], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_rows(rows.filter(F.col("dims") == dims).select("id", "x"), run, SCHEMA)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every embedding that has numbers, by 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
