"""Embedding whitening by matrix-free block Lanczos.

Entries become whole numbers, so that sums and deviations are exact whatever the
order in which tasks add them.  The covariance is never formed: a pass over the
vectors returns, for a block of directions v, the centred product X'Xv / n, and a
Krylov basis grows by one block a pass.  New directions are orthogonalised twice
against the whole basis; where a block loses rank, random directions orthogonal to
the basis take the lost places (a restart after breakdown).  The residuals of the
leading pairs end the iteration; a basis as wide as the vectors is exact.

The driver holds the basis and its image, two square matrices of the dimension at
most, and one row of sums for each dimension; no vector is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed

#: Entries are taken in steps of 1 / ``GRID`` from ``-SHIFT / GRID`` on.
GRID, SHIFT = 1024, 100_000
#: Numbers worked on at once in a Python worker.
PIECE = 1 << 18
#: A pair has converged when its residual is below this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Eigenvalues below this share of the trace, for each dimension, are those of no variance.
FLAT = 1e-15
_LONG = (1 << 63) - 1
#: Beyond this an entry's whole number counts as this much, so that it fits a long.
_MOST = float(1 << 62)


@dataclass(frozen=True)
class Whitener:
    """Means (as count and sums) and the leading eigenpairs of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as longs where these hold it, else as Python's whole numbers."""
        return _centred(x, self.n, self.sums)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def _whole(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(entries.astype(np.float64) * GRID), -_MOST, _MOST).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    most = max(map(abs, sums), default=0)
    if len(x) and (int(np.abs(x).max()) * n + most) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64) if most < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if centred.dtype != object:
        rough = (centred.astype(float) ** 2).sum(axis=1)
        if not len(rough) or rough.max() < 0.99 * _LONG:
            return (centred * centred).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in centred.tolist()]


def _blocks(column, width: int):
    """Ranges (i, j) of rows with their entries as whole numbers, a piece at a time."""
    rows = len(column)
    step = max(1, PIECE // width)
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width) if rows else np.zeros((0, width))
    for i in range(0, rows, step):
        yield i, min(rows, i + step), _whole(entries[i : i + step])


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    inf = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != inf)), F.lit(False))


def remaining(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) that can be whitened and their dimension: usable ones of the most
    frequent length, of equally frequent ones the longest."""
    rows = keyed(vectors, "vec_id", column).toDF("vec_id", "v").where(usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    head = widths.where("width > 0").orderBy(F.desc("n"), F.desc("width")).first()
    width = head.width if head else 0
    return rows.where(F.size("v") == width), width


def _sums(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums by dimension."""

    def run(batches):
        total, n = [0] * width, 0
        for b in batches:
            for _, _, x in _blocks(b.column(0), width):
                n += len(x)
                safe = int(np.abs(x).max()) * len(x) < 1 << 62
                part = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
                total = [a + int(v) for a, v in zip(total, part, strict=True)]
        # a sum in two parts, so that it stays exact when these are added
        high, low = [v >> 40 for v in total], [v & ((1 << 40) - 1) for v in total]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(-1, width), pa.int32()), "high": pa.array([0, *high], pa.int64()), "low": pa.array([n, *low], pa.int64())})

    kind = "decimal(38,0)"
    got = rows.select("v").mapInArrow(run, "k int, high bigint, low bigint").groupBy("k").agg(F.sum(F.col("high").cast(kind)).alias("high"), F.sum(F.col("low").cast(kind)).alias("low")).collect()
    by = {r.k: (int(r.high) << 40) + int(r.low) for r in got}
    return by.get(-1, 0), tuple(by.get(k, 0) for k in range(width))


def _trace(rows: DataFrame, width: int, n: int, sums: tuple[int, ...]) -> float:
    """The covariance's trace, from the rows' exact deviations."""

    def run(batches):
        total = 0
        for b in batches:
            for _, _, x in _blocks(b.column(0), width):
                total += sum(_deviations(_centred(x, n, sums)))
        # in the unit of V before it is rounded, so that partial sums stay small
        yield pa.RecordBatch.from_pydict({"t": pa.array([total / n**3 if n else 0.0], pa.float64())})

    return float(rows.select("v").mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0)


def _summed(rows: DataFrame, height: int, width: int, of) -> np.ndarray:
    """The sum over all rows' blocks of ``of(x)``, matrices of that shape."""
    names = [f"c{k}" for k in range(width)]

    def run(batches):
        total = np.zeros((height, width))
        for b in batches:
            for _, _, x in _blocks(b.column(0), of.width):
                total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *[pa.array(total[:, k]) for k in range(width)]], ["k", *names])

    parts = rows.select("v").mapInArrow(run, "k int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((height, width))
    for r in parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r.k] = r[1:]
    return out


@dataclass(frozen=True)
class _Product:
    """The centred product X'Xv / n of one piece of rows."""

    n: int
    sums: tuple[int, ...]
    block: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = (_centred(x, self.n, self.sums) / self.n).astype(float)
        return y.T @ (y @ self.block) / self.n


@dataclass(frozen=True)
class _Whitened:
    """The whitened rows' second moments of one piece."""

    model: Whitener

    @property
    def width(self) -> int:
        return len(self.model.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = self.model.project(self.model.centred(x))
        return w.T @ w / self.model.n


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """An orthonormal block beside ``basis`` that spans what ``block`` adds to it.

    Columns that add nothing (below ``scale``) are breakdowns; random ones replace
    them.  Fewer columns come back only where the space has no more."""
    width = basis.shape[0]
    out = np.zeros((width, 0))
    for column in block.T[: width - basis.shape[1]]:
        v = _beside(column, basis, out)
        least = scale
        while np.linalg.norm(v) <= least:
            v, least = _beside(rng.standard_normal(width), basis, out), 1e-8
        # the first turn cancels, the second and third leave nothing of what it left
        for _ in range(2):
            v = _beside(v / np.linalg.norm(v), basis, out)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def _beside(v: np.ndarray, basis: np.ndarray, out: np.ndarray) -> np.ndarray:
    v = v - basis @ (basis.T @ v)
    return v - out @ (out.T @ v)


def block_lanczos(product, width: int, count: int, scale: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``count`` largest eigenpairs of the symmetric operator ``product`` (block in,
    block out) on ``width`` dimensions, and the number of products taken.

    ``scale`` is the operator's trace.  Pairs come largest first."""
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    block, passes = orthogonal(rng.standard_normal((width, min(count + 4, width))), basis, rng, 0.0), 0
    while True:
        made = product(block)
        passes += 1
        basis, image = np.column_stack([basis, block]), np.column_stack([image, made])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:count], turn[:, ::-1][:, :count]
        residual = np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)
        if basis.shape[1] >= width or residual.max() <= TOLERANCE * max(values[0], 0.0):
            vectors, _ = np.linalg.qr(basis @ turn)
            return values, vectors, passes
        block = orthogonal(made, basis, rng, 1e-12 * scale)


def fit(rows: DataFrame, width: int, components: int) -> Whitener:
    """The whitener of rows (vec_id, v) of one dimension.

    Directions without variance are no components, so fewer may come than asked."""
    n, sums = _sums(rows, width) if width else (0, ())
    trace = _trace(rows, width, n, sums) if n else 0.0
    if trace <= 0:
        return Whitener(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0)
    count = min(components, width)
    values, vectors, passes = block_lanczos(lambda block: _summed(rows, width, block.shape[1], _Product(n, sums, block)), width, count, trace)
    keep = values > FLAT * width * trace
    return Whitener(n, sums, values[keep], vectors[:, keep], trace, passes)


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    return float(np.abs(_summed(rows, k, k, _Whitened(model)) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """Whitened coordinates of every usable vector, fitted on all of them.

    Takes ``vec_id`` and an array column of numbers; other columns are ignored.
    Returns vec_id, n, deviation (exact, null where a long can't hold it), whitened,
    explained (arrays by component, largest eigenvalue first) and identity_error.

    Null vectors, those with null or non-finite entries, empty ones, and ones of
    another length than the most frequent (the longest of equals) are left out.
    Entries x become floor(1024 x) + 100000; beyond 2**62 they count as that.
    Repeated rows and null ids are rows like any other.  Directions without variance
    are not whitened, so a table of equal vectors has empty arrays; an empty
    table stays empty.  Equal eigenvalues leave their directions to the seed.
    """
    rows, width = remaining(vectors, column)
    model = fit(rows, width, components)
    error, explained = identity_error(rows, model), (model.values / model.trace if model.trace else model.values).tolist()

    def run(batches):
        for b in batches:
            for i, j, x in _blocks(b.column(1), width):
                y = model.centred(x)
                out, k = model.project(y), len(model.values)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(out.ravel()))
                exact = pa.array([v if v <= _LONG else None for v in _deviations(y)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), exact, lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>").select(
        "vec_id", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error")
    )


def by_component(whitened: DataFrame) -> DataFrame:
    """Rows of ``whiten`` as one row for each vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    long = whitened.select("vec_id", "n", "deviation", "identity_error", pairs)
    return long.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
