"""Embedding whitening: blockwise QR of centred rows, then a bidiagonal qd solver.

An entry ``c`` counts as the integer ``x = floor(1024 c) + 100000``.  Exact sums give the mean.
Every task reduces its centred rows to a triangle, block by block; triangles are stacked
and reduced again in groups, level by level, so that one small triangle ``R`` is left with
``R'R`` = n times the covariance, never formed itself.  ``bidiagonal`` gives its singular
values and directions.

Edge cases: vectors that are null or hold null or non-finite entries take no part, nor do
vectors of another length than the most frequent one (the larger of several), without
entries, or with an entry whose ``x`` is no long.  Repeated rows and ids count as rows.  Of tied
components any orthonormal basis is taken, its signs so that the largest entry is positive.
Components whose eigenvalue is below 1e-20 of the first have no whitened form and are left out;
so equal vectors, one vector or none give no rows.  ``deviation`` is null where it is no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from siftline.llm.bidiagonal import singular_directions
from siftline.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Triangles reduced together, and numbers in a block of rows.
FAN = 16
BLOCK_VALUES = 1 << 20
#: Least eigenvalue of a component, relative to the first.
LEAST = 1e-20
#: Below this, sums of integers fit a long.
SAFE = float(1 << 62)
RESULT = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(), "explained": DoubleType(), "identity_error": DoubleType()}


@dataclass(frozen=True)
class Whitening:
    """A fit: number of rows, sums by place, unit directions by column, eigenvalues, their sum."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact; Python integers where longs do not suffice."""
        sums = np.array(self.sums, object)
        most = max(float(np.abs(x).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        if most * 2 < SAFE:
            return x * np.int64(self.n) - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x).astype(float) / self.n) @ self.directions / np.sqrt(self.values)


def _rows(vectors: DataFrame, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return vectors.select(*keep, F.col(vector).cast("array<double>").alias("_v")).where("_v is not null and size(_v) > 0")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that take part, in blocks, and their integers."""
    step = max(1, BLOCK_VALUES // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            part = part.filter(pc.equal(pc.list_value_length(part["_v"]), dim))
            # a null entry becomes nan
            values = np.asarray(part["_v"].flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim) * SCALE
            fits = (np.abs(values) < SAFE).all(axis=1)
            if fits.any():
                yield part.filter(pa.array(fits)), np.floor(values[fits]).astype(np.int64) + SHIFT


def _dimension(rows: DataFrame) -> int:
    """The most frequent length of the vectors that take part; 0 if there are none."""
    fits = F.forall("_v", lambda c: c.isNotNull() & (F.abs(c * SCALE) < F.lit(SAFE)))
    most = rows.where(fits).groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def _sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = [0] * dim, 0
        for _, x in _blocks(batches, dim):
            exact = x if float(np.abs(x).max()) * len(x) < SAFE else x.astype(object)
            totals = [t + int(s) for t, s in zip(totals, exact.sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim + 1), pa.int32()), pa.array([Decimal(t) for t in (*totals, n)], pa.decimal128(38, 0))], names=["place", "total"],
            )

    found = dict(rows.mapInArrow(add, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total")).collect())
    return int(found.get(dim, 0)), tuple(int(found[i]) for i in range(dim) if found)


def _triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _reduce(rows: DataFrame, mean: Whitening, dim: int) -> np.ndarray:
    """The triangle of all centred rows."""
    schema = "part bigint, place int, line array<double>"

    def lines(part: int, triangle: np.ndarray) -> list[pa.Array]:
        k = len(triangle)
        return [pa.array(np.full(k, part), pa.int64()), pa.array(range(k), pa.int32()), pa.array(list(triangle), pa.list_(pa.float64()))]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, dim))
        for _, x in _blocks(batches, dim):
            triangle = _triangle(np.vstack([triangle, mean.deviations(x).astype(float) / mean.n]))
        if len(triangle):
            yield pa.RecordBatch.from_arrays(lines(TaskContext.get().partitionId(), triangle), names=["part", "place", "line"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")])
        stack = np.asarray(table["line"].combine_chunks().flatten()).reshape(-1, dim)
        return pa.table(lines(table["part"][0].as_py() // FAN, _triangle(stack)), names=["part", "place", "line"])

    held = cut_lineage(rows.mapInArrow(own, schema), "triangles")
    while held.agg(F.max("part")).first()[0] > 0:
        held = cut_lineage(held.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merge, schema), "triangles")
    out = np.zeros((dim, dim))
    for row in held.collect():
        out[row["place"]] = row["line"]
    return out


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean and leading directions of all vectors; None without a direction.

    What reaches the driver is one number per place and one triangle.
    """
    rows = _rows(vectors, vector)
    dim = _dimension(rows)
    if not dim:
        return None
    n, sums = _sums(rows, dim)
    mean = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    squares, directions = singular_directions(_reduce(rows, mean, dim), components, LEAST)
    if not directions.shape[1]:
        return None
    top = directions[np.abs(directions).argmax(axis=0), range(directions.shape[1])]
    return Whitening(n, sums, directions * np.sign(top), squares[:directions.shape[1]] / n, float(squares.sum()) / n)


def identity_error(vectors: DataFrame, fit: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    dim, k = len(fit.sums), len(fit.values)
    i, j = (a.ravel() for a in np.indices((k, k + 1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for _, x in _blocks(batches, dim):
            w = fit.whiten(x)
            total += w.T @ np.hstack([w, np.ones((len(w), 1))])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    found = np.zeros((k, k + 1))
    for row in _rows(vectors, vector).mapInArrow(add, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[row["i"], row["j"]] = row["total"] / fit.n
    covariance = found[:, :k] - np.outer(found[:, k], found[:, k])
    return float(np.abs(covariance - np.eye(k)).max())


def _exact_squares(away: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null where they are no long."""
    most = float(max(abs(int(away.max(initial=0))), abs(int(away.min(initial=0)))))
    if most * most * away.shape[1] < SAFE:
        return (away * away).sum(axis=1).tolist()
    wide = away.astype(object)
    return [t if t < 1 << 63 else None for t in (wide * wide).sum(axis=1).tolist()]


def whiten_rows(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component: the ``keep`` columns and ``RESULT``.

    A kept column named like a result column is left out.
    """
    kept = tuple(c for c in keep if c not in RESULT)
    rows = _rows(vectors, vector, kept)
    schema = StructType(rows.schema.fields[:-1] + [StructField(name, kind) for name, kind in RESULT.items()])
    fit = fit_whitening(vectors, vector, components)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fit, vector)
    dim, k = len(fit.sums), len(fit.values)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            m = len(x)
            own = part.take(pa.array(np.repeat(np.arange(m), k))).columns[:-1]
            squares = _exact_squares(fit.deviations(x))
            made = [
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fit.n), pa.int64()),
                pa.array([s for s in squares for _ in range(k)], pa.int64()), pa.array(fit.whiten(x).ravel()),
                pa.array(np.tile(fit.values / fit.trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return rows.mapInArrow(emit, schema)


def apply_whitening(vectors: DataFrame, fit: Whitening, vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """The rows that take part, with all their columns and the whitened vector in ``out``.

    A column already named ``out`` is replaced.
    """
    dim = len(fit.sums)
    rows = _rows(vectors.select(F.struct(*vectors.columns).alias("doc"), F.col(vector).alias(vector)), vector, ("doc",))
    schema = StructType([rows.schema["doc"], StructField("value", rows.schema["_v"].dataType)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim):
            yield pa.RecordBatch.from_arrays([part["doc"], pa.array(list(fit.whiten(x)), pa.list_(pa.float64()))], names=["doc", "value"])

    made = rows.mapInArrow(emit, schema)
    return made.select(*(F.col("doc")[c].alias(c) for c in vectors.columns if c != out), F.col("value").alias(out))
