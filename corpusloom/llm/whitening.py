"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Vectors are put on an integer grid, x = floor(SCALE * entry) + SHIFT, and fitted on the distinct ones. A partition keeps, whatever its rows, their number, their
sums (exact integers, so the mean is exact as well) and all singular values and right vectors of its centred rows. Two such summaries
merge without loss: under the singular vectors times their values of both comes one row more, the difference of the means times
sqrt(n1 * n2 / (n1 + n2)), and the stack is decomposed anew, with all dimensions retained. Batches are merged within a partition, and partitions
in a tree. No covariance matrix is ever formed, so small components keep their precision.

Passes: the distinct grid vectors (one shuffle of a byte or two an entry), written once; summaries of them; their whitened covariance, which tells how
far it is from the identity; and the rows. The driver holds one model a vector length, of COMPONENTS vectors.

Edge cases: vectors that are null or hold null or non-finite entries are left out, as are entries of a magnitude of 2^31 / SCALE or more. Vectors of different
lengths are fitted apart (there should be few lengths); one of length n has at most n components, an empty one none. Repeated rows are each given, the fit counts
equal vectors once. A component without variance (less than 1e-12 of the largest) has whitened 0 and takes no part in identity_error, which is 0 if there is
none at all; explained is 0 if there's no variance. Equal eigenvalues have any basis of their space, the same for all rows. A deviation beyond 64 bits is
null. A null vec_id is a row like others. Only id and vector are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column_of
from .sparkutil import cut
from .vectors import merged, on_grid, packed, slot, unpacked

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that one decomposition takes.
ROWS = 8192
NO_VARIANCE = 1e-12

#: Number of vectors, exact sums, singular values, right singular vectors as rows.
Summary = tuple[int, list[int], np.ndarray, np.ndarray]


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not rows.shape[1]:
        return np.zeros(0), np.zeros((0, 0))
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def summary(x: np.ndarray) -> Summary:
    """Of the rows of an integer matrix."""
    n, sums = len(x), x.sum(axis=0)
    return n, [int(s) for s in sums], *_decomposed((n * x - sums) / n)


def joined(a: Summary, b: Summary) -> Summary:
    n = a[0] + b[0]
    # Means differ by whole numbers over a[0] * b[0]: exact before the one division.
    apart = np.array([(s * b[0] - t * a[0]) / (a[0] * b[0]) for s, t in zip(a[1], b[1])])
    correction = np.sqrt(a[0] / n * b[0]) * apart
    values, vectors = _decomposed(np.vstack([a[2][:, None] * a[3], b[2][:, None] * b[3], correction[None, :]]))
    return n, [s + t for s, t in zip(a[1], b[1])], values, vectors


class Model:
    """The whitening of vectors of one length."""

    def __init__(self, found: Summary, total: float, components: int) -> None:
        self.n, self.sums, values, vectors = found
        k = min(components, len(self.sums))
        variance = np.zeros(k)
        variance[: len(values)] = (values**2 / self.n)[:k]
        axes = np.zeros((k, len(self.sums)))
        axes[: len(values)] = vectors[:k]
        # One sign for all: the entry of the largest magnitude is positive.
        signs = np.array([-1.0 if len(a) and a[np.abs(a).argmax()] < 0 else 1.0 for a in axes])
        self.axes, self.variance = axes * signs[:, None], variance
        self.explained = variance / total if total > 0 else variance * 0
        self.real = variance > NO_VARIANCE * max(variance.max(initial=0.0), 0.0)
        self.error = 0.0

    def whitened(self, away: np.ndarray) -> np.ndarray:
        """(rows, components) of n * x - sums."""
        out = np.asarray(away, dtype=np.float64) / self.n @ self.axes.T
        return np.where(self.real, out / np.sqrt(np.where(self.real, self.variance, 1.0)), 0.0)

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums of grid vectors with their shift: exact, as long as 64 bits hold it."""
        most = max(max((abs(s) for s in self.sums), default=0), self.n * int(np.abs(x).max(initial=0)))
        if most < 1 << 61:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)


def deviations(away: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond 64 bits."""
    if away.dtype != object and float(np.abs(away).max(initial=0)) ** 2 * max(away.shape[1], 1) < 2.0**62:
        return (away * away).sum(axis=1).tolist()
    return [t if (t := sum(v * v for v in row)) < 1 << 63 else None for row in away.astype(object).tolist()]


def distinct(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(dim, code): each grid vector once, without its shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in on_grid(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], dtype=np.int32)), pa.array(packed(x), pa.binary())], ["dim", "code"])

    return vectors.select(embedding).mapInArrow(run, "dim int, code binary").distinct()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, grid vectors) of a batch of (dim, code), in steps of ROWS."""
    dims, codes = column_of(batch, "dim").to_numpy(), column_of(batch, "code")
    for dim in np.unique(dims).tolist():
        own = codes.take(pa.array(np.flatnonzero(dims == dim))).to_pylist()
        for at in range(0, len(own), ROWS):
            yield dim, unpacked(own[at : at + ROWS], dim)


def fit(grid: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> dict[int, Model]:
    """The model of each length of the vectors of grid(dim, code), which is read twice."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Summary] = {}
        for batch in batches:
            for dim, x in _by_length(batch):
                new = summary(x + shift)
                held[dim] = joined(held[dim], new) if dim in held else new
        if held:
            payloads = [pickle.dumps(held[d]) for d in held]
            yield pa.RecordBatch.from_arrays([pa.array([slot()] * len(held), pa.int64()), pa.array(list(held), pa.int32()), pa.array(payloads, pa.binary())], ["slot", "dim", "payload"])

    def combine(a: bytes, b: bytes) -> bytes:
        return pickle.dumps(joined(pickle.loads(a), pickle.loads(b)))

    def shortened(payload: bytes) -> bytes:
        n, sums, values, vectors = pickle.loads(payload)
        return pickle.dumps(((n, sums, values[:components], vectors[:components]), float((values**2).sum() / n)))

    parts = grid.mapInArrow(summaries, "slot long, dim int, payload binary")
    found = merged(parts, grid.rdd.getNumPartitions(), combine, shortened)
    models = {dim: Model(*pickle.loads(payload), components) for dim, payload in found.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in _by_length(batch):
                w = models[dim].whitened(models[dim].away(x + shift))
                held[dim] = held.get(dim, 0) + w.T @ w
        if held:
            payloads = [held[d].tobytes() for d in held]
            yield pa.RecordBatch.from_arrays([pa.array([slot()] * len(held), pa.int64()), pa.array(list(held), pa.int32()), pa.array(payloads, pa.binary())], ["slot", "dim", "payload"])

    def added(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    parts = grid.mapInArrow(products, "slot long, dim int, payload binary")
    for dim, payload in merged(parts, grid.rdd.getNumPartitions(), added).items():
        m = models[dim]
        covariance = np.frombuffer(payload).reshape(len(m.variance), len(m.variance)) / m.n
        some = covariance[np.ix_(m.real, m.real)]
        m.error = float(np.abs(some - np.eye(len(some))).max(initial=0.0))
    return models


def whitened(vectors: DataFrame, models: dict[int, Model], vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector on the grid and each component."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # COMPONENTS vectors for each length
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "vec_id")
            for rows, x in on_grid(column_of(batch, "v"), scale):
                m = shared.value[x.shape[1]]
                k = len(m.variance)
                for at in range(0, len(rows) if k else 0, 4096):
                    own = rows[at : at + 4096]
                    away = m.away(x[at : at + 4096] + shift)
                    many = np.repeat(np.arange(len(own)), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(own[many])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(many), m.n)),
                            pa.array(deviations(away), pa.int64()).take(pa.array(many)), pa.array(m.whitened(away).ravel()), pa.array(np.tile(m.explained, len(own))), pa.array(np.full(len(many), m.error)),
                        ],
                        names,
                    )

    kind = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    grid = cut(distinct(vectors, embedding))
    return whitened(vectors, fit(grid), vec_id, embedding)
