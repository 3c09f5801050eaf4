"""Embedding whitening by incremental eigendecomposition.

1. Count and exact per-dimension sums, so every vector is centred before it is
   multiplied, however far the data lie from zero.
2. Each task holds the spectrum of the vectors it has seen and takes further ones
   in as rank-one updates: the new eigenvalues are the roots of the secular
   equation, between the old ones, found for all roots at once; vanishing and
   equal terms are deflated first, and the update vector is recomputed from the
   roots, which keeps the eigenvectors orthogonal. A block of vectors is first
   turned into its triangular factor, which has the same sum of outer products,
   so that one update per dimension stands for thousands.
3. Spectra of tasks are combined the same way, ``FAN_IN`` at a time up a tree:
   each pair (value, vector) of one is a rank-one update of the other.
4. Rayleigh-Ritz: all vectors are projected on the found basis, the small
   projected covariance is summed up the same tree and diagonalised, and the
   basis is turned by its eigenvectors. This is repeated until the covariance of
   the whitened vectors, measured over all rows, is the identity.

A spectrum and a covariance are dims * dims numbers; nothing that grows with the
rows leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.registry import query
from vitalgrid.session import cut_lineage

COMPONENTS = 32
FAN_IN = 8
BLOCK = 4_096
ROUNDS = 4
CLOSE = 1e-9
#: Scaled entries beyond this size count as this size.
WIDEST = 2**40
LONG = 2**63 - 1
EPS = float(np.finfo(float).eps)


@dataclass
class Spectrum:
    """Eigenvalues, rising, and eigenvectors as columns."""

    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(np.zeros(dims), np.eye(dims))

    def add(self, vector: np.ndarray) -> None:
        """The spectrum of this matrix plus the outer product of ``vector`` with itself."""
        z = self.vectors.T @ vector
        size = float(np.abs(z).max(initial=0.0))
        if size == 0.0:
            return
        tiny = 8 * EPS * max(float(self.values[-1]), size * size)
        self._deflate_equal(z, tiny)
        moves = np.abs(z) * size > tiny
        if not moves.any():
            return
        roots, turned = _rank_one(self.values[moves], z[moves])
        values, vectors = self.values.copy(), self.vectors.copy()
        values[moves], vectors[:, moves] = roots, self.vectors[:, moves] @ turned
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def _deflate_equal(self, z: np.ndarray, tiny: float) -> None:
        """Equal eigenvalues share a space: turn it so that ``z`` has one entry in it."""
        starts = np.flatnonzero(np.diff(self.values, prepend=-np.inf) > tiny)
        sizes = np.diff(np.append(starts, len(z)))
        for a, b in zip(starts[sizes > 1], (starts + sizes)[sizes > 1], strict=True):
            part = z[a:b]
            length = float(np.linalg.norm(part))
            if length == 0.0:
                continue
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            mirror /= np.linalg.norm(mirror)
            own = self.vectors[:, a:b]
            own -= np.outer(own @ mirror, 2 * mirror)
            z[a : b - 1], z[b - 1] = 0.0, -np.copysign(length, part[-1])


def _rank_one(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(poles) + z z^T for distinct rising poles and z without zeros."""
    k, squares = len(poles), z * z
    upper = np.append(poles[1:], poles[-1] + squares.sum())
    half = (upper - poles) / 2
    # Each root is written as its nearer pole and a distance, so that the distance keeps all its digits.
    at_half = 1 + (squares[:, None] / (poles[:, None] - (poles + half)[None, :])).sum(axis=0)
    near = np.arange(k)
    right = (at_half < 0) & (near < k - 1)
    near = near + right
    gaps = poles[:, None] - poles[near][None, :]
    lo = np.where(right, -half, 0.0)
    hi = np.where(right, 0.0, half)
    hi[-1] = 2 * half[-1] if at_half[-1] < 0 else hi[-1]
    others = squares[:, None].repeat(k, axis=1)
    others[near, np.arange(k)] = 0.0
    own = squares[near]
    tau = (lo + hi) / 2
    for _ in range(100):
        apart = gaps - tau
        apart[near, np.arange(k)] = 1.0
        ratio = others / apart
        rest = 1 + ratio.sum(axis=0)
        # tau * f(tau): smooth between the poles, and f's sign is known.
        value = tau * rest - own
        below = np.where(tau > 0, value < 0, value > 0)
        lo, hi = np.where(below, tau, lo), np.where(below, hi, tau)
        # As small as rounding of its terms lets it be.
        found = np.abs(value) <= 8 * EPS * (np.abs(tau) * (1 + np.abs(ratio).sum(axis=0)) + own)
        if found.all():
            break
        slope = rest + tau * (ratio / apart).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = tau - value / slope
        tau = np.where(found, tau, np.where((step > lo) & (step < hi), step, (lo + hi) / 2))
    apart = gaps - tau  # pole i minus root j
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    factors = apart / between
    np.fill_diagonal(factors, 1.0)
    z = np.copysign(np.sqrt(np.abs(factors.prod(axis=1) * np.diag(apart))), z)
    vectors = z[:, None] / apart
    return poles[near] + tau, vectors / np.linalg.norm(vectors, axis=0)


def add_rows(spectrum: Spectrum, centred: np.ndarray) -> None:
    """Take rows in, a block at a time as its triangular factor."""
    for at in range(0, len(centred), BLOCK):
        block = centred[at : at + BLOCK]
        for row in np.linalg.qr(block, mode="r") if len(block) > block.shape[1] else block:
            spectrum.add(row)


@dataclass
class Whitening:
    """What the tasks need: exact count and sums, the components as columns, their eigenvalues, and the trace."""

    count: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """count * x - sums, exact: longs where they fit, else integers of any length."""
        if self.count * max(int(np.abs(x).max(initial=0)), 1) < 2**61:
            return x * self.count - np.array(self.sums, np.int64)
        return np.vectorize(int, otypes=[object])(x) * self.count - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.count

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of squared numerators; null where one does not fit a long."""
        top = self.numerators(x)
        if top.dtype != object and float(np.abs(top).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return pa.array((top * top).sum(axis=1))
        return pa.array([d if (d := sum(int(v) ** 2 for v in row)) <= LONG else None for row in top.tolist()], pa.int64())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


PARTIAL = "part int, values array<double>, matrix array<double>"


def _partial(rows: DataFrame, dims: int, start: Callable, take: Callable, end: Callable) -> DataFrame:
    """One row per task: what ``take`` gathers over its vectors."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held = start() if held is None else held
                held = take(held, _rows_of(batch.slice(at, BLOCK), dims))
        if held is not None:
            values, matrix = end(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int32()),
                    pa.array([values.tolist()], pa.list_(pa.float64())), pa.array([matrix.ravel().tolist()], pa.list_(pa.float64())),
                ],
                names=["part", "values", "matrix"],
            )

    return rows.select("x").mapInArrow(gathered, PARTIAL)


def _up_the_tree(parts: DataFrame, merge: Callable[[list[np.ndarray], list[np.ndarray]], tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Merge the tasks' rows ``FAN_IN`` at a time, in the order of the parts, down to one."""

    def merged(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("part")
        values, matrix = merge([np.array(v) for v in some["values"]], [np.array(m) for m in some["matrix"]])
        return pd.DataFrame({"part": [key[0]], "values": [values.tolist()], "matrix": [matrix.ravel().tolist()]})

    parts = cut_lineage(parts)
    most = parts.agg(F.max("part")).first()[0]
    while most:
        most //= FAN_IN
        parts = cut_lineage(parts.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("group")).applyInPandas(merged, PARTIAL))
    row = parts.first()
    return np.array(row["values"]), np.array(row["matrix"])


def _spectrum(rows: DataFrame, model: Whitening, dims: int) -> Spectrum:
    def take(held: Spectrum, x: np.ndarray) -> Spectrum:
        add_rows(held, model.centred(x))
        return held

    def merge(values: list[np.ndarray], vectors: list[np.ndarray]) -> tuple:
        held = Spectrum(values[0], vectors[0].reshape(dims, dims))
        for value, vector in zip(values[1:], vectors[1:], strict=True):
            for pair in np.flatnonzero(value > 0):
                held.add(np.sqrt(value[pair]) * vector.reshape(dims, dims)[:, pair])
        return held.values, held.vectors

    parts = _partial(rows, dims, lambda: Spectrum.empty(dims), take, lambda s: (np.maximum(s.values, 0.0), s.vectors))
    return Spectrum(*(x if i == 0 else x.reshape(dims, dims) for i, x in enumerate(_up_the_tree(parts, merge))))


def _covariance(rows: DataFrame, dims: int, count: int, project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Covariance (divisor ``count``) of what ``project`` gives for all rows; its sums are kept beside the products."""

    def take(held: tuple, x: np.ndarray) -> tuple:
        p = project(x)
        return held[0] + p.sum(axis=0), held[1] + p.T @ p

    parts = _partial(rows, dims, lambda: (np.zeros(width), np.zeros((width, width))), take, lambda h: h)
    sums, products = _up_the_tree(parts, lambda values, matrices: (np.sum(values, axis=0), np.sum(matrices, axis=0)))
    mean = sums / count
    return products.reshape(width, width) / count - np.outer(mean, mean)


def scaled(embedding: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry, as longs."""
    return F.transform(
        embedding,
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(WIDEST))), F.lit(-float(WIDEST)))).cast("long") + F.lit(shift).cast("long"),
    )


def finite(embedding: Column) -> Column:
    """Neither the vector nor an entry is null or non-finite, and there is an entry."""
    broken = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | F.abs(x.cast("double")).isin(float("inf")))
    return F.coalesce(embedding.isNotNull() & ~broken & (F.size(embedding) > 0), F.lit(False))


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Exact count and sums, from one row per batch."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows_of(batch, dims)
                n = np.full(dims, batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(n), pa.array(x.sum(axis=0))], names=["dim", "n", "s"])

    got = (
        rows.select("x").mapInArrow(summed, "dim long, n long, s long").groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    )
    return got[0]["n"], [int(r["s"]) for r in got]


def fit_whitening(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows' ``x`` (arrays of ``dims`` longs); None where all rows are equal."""
    count, sums = _sums(rows, dims)
    model = Whitening(count, sums, np.eye(dims), np.ones(dims), 1.0)
    basis = _spectrum(rows, model, dims).vectors
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(basis)
        small = _covariance(rows, dims, count, lambda x, basis=basis: model.centred(x) @ basis, dims)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        basis = basis @ turn
        order = np.argsort(-values, kind="stable")
        order = order[values[order] > dims * EPS * max(values[order[0]], 0.0)][:components]
        if not len(order):
            return None
        found = Whitening(count, sums, basis[:, order], values[order], float(np.trace(small)))
        error = np.abs(_covariance(rows, dims, count, found.whitened, len(order)) - np.eye(len(order))).max()
        found.identity_error = float(error)
        if error <= CLOSE:
            break
    return found


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + shift. With n vectors and sums S,
    ``deviation`` is the sum of (n * x - S)^2 over the dimensions, exact, and null
    where it does not fit a long; ``whitened`` is x - S / n on a unit eigenvector
    of the covariance (divisor n), over the root of its eigenvalue; ``explained``
    the eigenvalue's share of the trace; ``identity_error`` how far the whitened
    rows' own covariance is from the identity. Components are numbered from 1 by
    falling eigenvalue. Those without variance (fewer rows than dimensions, equal
    rows) have no whitened form and are left out.

    Vectors that are null, empty, or hold a null or non-finite entry give no rows
    and are not fitted. Vectors of another length than the most common one (the
    shorter of two equally common) belong to no space here and give no rows
    either. Repeated rows and rows with equal or null vec_ids count and are
    returned one by one. Scaled entries beyond 2**40 count as that. Other columns
    are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(
        vectors.filter(finite(F.col("embedding")))
        .select(F.col("vec_id").cast("long"), scaled(F.col("embedding"), scale, shift).alias("x"))
    )
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    model = None
    if common is not None:
        rows = rows.filter(F.size("x") == common["dims"])
        model = fit_whitening(rows, common["dims"], components)
    if model is None:
        return spark.createDataFrame([], WHITE)
    dims, k = common["dims"], len(model.values)
    explained = model.values / model.trace

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                some = batch.slice(at, 1_024)
                m = some.num_rows
                x = _rows_of(some.select(["x"]), dims)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.count)), model.deviations(x).take(again), pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("x", "vec_id").mapInArrow(applied, WHITE)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the 32 leading components."""
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
