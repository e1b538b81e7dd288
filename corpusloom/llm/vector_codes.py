"""Vector code compression: product codes whose codebooks are learned by Lloyd rounds with Hamerly's bounds.

Each entry becomes floor(SCALE * entry); a vector is cut into PARTS equal consecutive parts, and each part is coded by the index of the nearest of ENTRIES
codebook entries (squared Euclidean distance in whole numbers, ties to the lower index). A codebook starts as that part of the vectors of the smallest ids;
each of ROUNDS rounds assigns all parts and moves every entry to the floor of its parts' mean.

Between rounds a row keeps, for each part, its index, one upper bound of the distance to its entry and one lower bound of the distance to any other.
An entry's move is added to the one, the largest move of the others taken from the other. A part whose upper bound stays strictly below its lower bound, or
below half the distance from its entry to the nearest other, keeps its index unseen; else the upper bound is made exact, and if that fails too, all entries
are looked at. Strictness keeps ties right: only a unique nearest entry is ever kept. Bounds are widened by SLACK, more than their rounding.

A round is one pass over persisted rows (grid integers in a byte or two each, bounds in eight) and an aggregation of whole sums, merged in a tree; the driver
holds codebooks alone. A lost executor's rows are recomputed from the table through at most ROUNDS passes.

Edge cases: vectors that are null or hold null or non-finite entries, or any of a magnitude of 2^31 / SCALE or more, are left out. Vectors of different lengths
are coded apart, each with its codebooks (there should be few lengths); a length that PARTS doesn't divide is filled up with zeros. With fewer
rows than ENTRIES, all are entries. Null ids come last and, like ids that repeat, go in the order of their integers. Equal entries leave the later ones unused. Equal
vectors have equal codes. A sum of errors beyond 64 bits is null. Only id, vector and label are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column_of
from .sparkutil import cut
from .vectors import merged, on_grid, packed, slot, unpacked

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SLACK = 1e-12
#: Rows that are compared with all entries at once.
ROWS = 4096
#: Tasks among which the rows of one label are spread.
WAYS = 16


class Codebook:
    """The entries of one part, and what moving there from an earlier one does to bounds."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None) -> None:
        self.entries = entries
        self.wide = entries.astype(np.float64)
        self.norms = (self.wide**2).sum(axis=1)
        self.most = int(np.abs(entries).max(initial=0))
        apart = np.sqrt(np.maximum(self.norms[:, None] - 2 * self.wide @ self.wide.T + self.norms, 0.0)) if self.fits(entries) else np.zeros((len(entries), len(entries)))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1, initial=np.inf) / 2 * (1 - SLACK)
        if before is not None:
            moved = np.sqrt(((entries - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
            order = np.argsort(-moved, kind="stable")
            self.moved = moved
            self.others = np.full(len(moved), moved[order[0]])
            self.others[order[0]] = moved[order[1]] if len(moved) > 1 else 0.0

    def fits(self, x: np.ndarray) -> bool:
        """Whether squared distances to x are whole numbers that doubles hold exactly."""
        return (int(np.abs(x).max(initial=0)) + self.most) ** 2 * max(x.shape[1], 1) * 4 < 1 << 53

    def squares(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact squared distances to the entries at."""
        d = x - self.entries[at]
        if not self.fits(x):
            d = d.astype(object)
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, distance, distance of the second) by a look at all entries."""
        every = np.arange(len(x))
        if self.fits(x):
            y = x.astype(np.float64)
            d = (y * y).sum(axis=1)[:, None] - 2 * (y @ self.wide.T) + self.norms
        else:
            d = np.stack([((x.astype(object) - e.astype(object)) ** 2).sum(axis=1) for e in self.entries], axis=1)
        at = d.argmin(axis=1)
        least = d[every, at].astype(np.float64)
        if d.shape[1] > 1:
            d[every, at] = d.max() + 1
            second = d.min(axis=1).astype(np.float64)
        else:
            second = np.full(len(x), 1e300)
        return at, np.sqrt(least) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)

    def again(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings (at, upper, lower) of an earlier codebook to this one, in place; the number of parts that were compared with all entries."""
        upper += self.moved[at]
        upper *= 1 + SLACK
        lower -= self.others[at] + SLACK * np.abs(lower)
        rows = np.flatnonzero(upper >= np.maximum(self.half[at], lower))
        if len(rows):
            upper[rows] = np.sqrt(self.squares(x[rows], at[rows]).astype(np.float64)) * (1 + SLACK)
            rows = rows[upper[rows] >= np.maximum(self.half[at[rows]], lower[rows])]
        if len(rows):
            at[rows], upper[rows], lower[rows] = self.nearest(x[rows])
        return len(rows)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    """The parts of grid vectors, those of a length that PARTS doesn't divide filled up with zeros."""
    fill = -x.shape[1] % PARTS
    return np.split(np.pad(x, ((0, 0), (0, fill))), PARTS, axis=1)


def moved_entries(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The floors of the means; unused entries stay."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], entries)


_STATE = ["id", "label", "x", "at", "upper", "lower"]


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, grid vectors, and for each row and part index, upper and lower bound) in steps of ROWS."""
    for start in range(0, batch.num_rows, ROWS):
        rows = batch.slice(start, ROWS)
        x = unpacked(column_of(rows, "x").to_pylist(), dim)
        at = np.frombuffer(b"".join(column_of(rows, "at").to_pylist()), dtype=np.uint16).reshape(len(x), PARTS).astype(np.int64)
        upper, lower = (np.frombuffer(b"".join(column_of(rows, c).to_pylist())).reshape(len(x), PARTS).copy() for c in ("upper", "lower"))
        yield rows, x, at, upper, lower


def _bytes(a: np.ndarray) -> pa.Array:
    raw, step = a.tobytes(), a.shape[1] * a.itemsize
    return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())


def grid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, dim, x): the vectors that are kept, their integers as bytes."""
    source = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in on_grid(column_of(batch, "v"), scale):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([column_of(batch, "id").take(at), column_of(batch, "label").take(at), pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)), pa.array(packed(x), pa.binary())], ["id", "label", "dim", "x"])

    return source.mapInArrow(run, f"{kinds}, dim int, x binary")


def _sums(state: DataFrame, dim: int, entries: int) -> np.ndarray:
    """(PARTS, entries, width + 1) sums of the parts of each entry, and their number."""
    shape = (PARTS, entries, -(-dim // PARTS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for batch in batches:
            for _, x, at, _, _ in _rows(batch, dim):
                for p, part in enumerate(_cut(x)):
                    order = np.argsort(at[:, p], kind="stable")
                    own = at[order, p]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    total[p, own[first], :-1] += np.add.reduceat(part[order], first, axis=0)
                    total[p, :, -1] += np.bincount(own, minlength=entries)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([slot()], pa.int64()), pa.array([dim], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "dim", "payload"])

    def added(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, dtype=np.int64) + np.frombuffer(b, dtype=np.int64)).tobytes()

    parts = state.mapInArrow(run, "slot long, dim int, payload binary")
    return np.frombuffer(merged(parts, state.rdd.getNumPartitions(), added)[dim], dtype=np.int64).reshape(shape)


def fitted(rows: DataFrame, dim: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error) of rows(id, label, x), the codebooks of all parts)."""
    first = rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = [Codebook(p) for p in _cut(unpacked([bytes(r["x"]) for r in first], dim))]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    schema = f"{kinds}, x binary, at binary, upper binary, lower binary"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                own = batch.slice(start, ROWS)
                found = [b.nearest(p) for b, p in zip(books, _cut(unpacked(column_of(own, "x").to_pylist(), dim)))]
                at, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                yield pa.RecordBatch.from_arrays([*(column_of(own, c) for c in _STATE[:3]), _bytes(at.astype(np.uint16)), _bytes(upper), _bytes(lower)], _STATE)

    def moving(now: list[Codebook]):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, x, at, upper, lower in _rows(batch, dim):
                    for p, (book, part) in enumerate(zip(now, _cut(x))):
                        book.again(part, at[:, p], upper[:, p], lower[:, p])
                    yield pa.RecordBatch.from_arrays([*(column_of(own, c) for c in _STATE[:3]), _bytes(at.astype(np.uint16)), _bytes(upper), _bytes(lower)], _STATE)

        return step

    state = rows.select("id", "label", "x").mapInArrow(begin, schema)
    older: list[DataFrame] = []
    now = books
    for _ in range(rounds):
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        total = _sums(state, dim, len(first))
        # All rows of this round are held now: those before are not read again but to replace lost ones.
        for df in older:
            df.unpersist()
        older = [state]
        now = [Codebook(moved_entries(b.entries, t[:, :-1], t[:, -1]), b.entries) for b, t in zip(now, total)]
        state = state.mapInArrow(moving(now), schema)
    last = now

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x, at, _, _ in _rows(batch, dim):
                error = sum(book.squares(part, at[:, p]) for p, (book, part) in enumerate(zip(last, _cut(x))))
                codes = ["".join(f"{k:02x}" for k in row) for row in at.tolist()]
                yield pa.RecordBatch.from_arrays([column_of(own, "id"), column_of(own, "label"), pa.array(codes), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["id", "label", "code", "error"])

    found = cut(state.mapInArrow(coded, f"{kinds}, code string, error long"))
    for df in older:
        df.unpersist()
    return found, [b.entries for b in last]


def listed(codebooks: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(v) for book in codebooks for v in book.ravel().tolist())


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that is kept."""
    kept = grid(vectors, vec_id, embedding, label)
    found = None
    for dim in sorted(r["dim"] for r in kept.select("dim").distinct().collect()):
        coded, books = fitted(kept.where(F.col("dim") == dim), dim)
        coded = coded.withColumn("codebooks_sha256", F.lit(hashlib.sha256(listed(books).encode()).hexdigest()))
        found = coded if found is None else found.unionByName(coded)
    if found is None:
        return kept.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # A label of a third of all rows is spread over WAYS tasks.
    sums = found.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    rows = found.withColumn("way", F.expr(f"int(pmod(xxhash64(id, code), {WAYS}))"))
    out = rows.join(sums.withColumnRenamed("label", "_label"), (rows.way == sums.way) & F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, all distances anew in each round."""
    dot = "list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS y FROM p WHERE r <= {ENTRIES})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, part, min({{'d': {dot.format(x='x', y='y')}, 'e': entry}}) AS m FROM p JOIN c{t} USING (part) GROUP BY r, part)")
        if t < rounds:
            parts.append(f"""s{t} AS (SELECT part, m.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{t} JOIN p USING (r, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL)""")
            parts.append(f"""m{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM s{t} GROUP BY part, entry)""")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN m{t} USING (part, entry))")
    last = rounds
    return f"""
        WITH {", ".join(parts)},
        h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last}),
        e AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(a.m.e)), 2, '0'), '' ORDER BY a.part) AS code, sum(a.m.d)::BIGINT AS error FROM a{last} a JOIN k USING (r) GROUP BY k.r, k.vec_id, k.label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h"""
