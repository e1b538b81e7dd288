"""Nearest vectors by cosine from an inverted file: cells, residual product codes, exact re-ranking.

Unit vectors are dealt to the cells of a spherical k-means, PER_CELL of them to a cell on average, up to CELLS_MOST cells. What is left of a vector beside its cell's
centre is cut into parts, and each part is coded by the nearest of 256 entries. A query looks at the codes of its PROBES nearest cells only, takes the RERANK best by
their codes and compares those by exact cosine. So the codes that a query looks at do not grow with the table (up to PER_CELL * CELLS_MOST vectors, from there on
in proportion), and the table can be stored by cells, where a search reads the folders of its cells alone.

Centres and entries are fitted in Spark on a sample of at most SAMPLE_PER_CELL vectors a cell, chosen by a hash of the id: each round is a pass over the sample with
partial sums, and the driver holds centres. Every vector is indexed. A cell of more than BLOCK vectors, or one that more than BLOCK queries ask for, is cut into pieces.

`search` is approximate: a neighbour in a cell that wasn't looked at, or whose code is far off, is missed. The tests hold its recall on planted neighbours against brute
force. `exact` misses none: it takes what `search` found as a bound and compares each query with all vectors of every cell that may hold a better one, by the angles of the cell's
vectors to its centre. Without clusters those are a share of all cells, so its work then grows with queries times vectors.

Edge cases: vectors that are null, empty, zero or hold null or non-finite entries, and those of another length than the index has, match nothing; a null id is
not indexed. Equal scores go to the smaller id. Rows that repeat an id are indexed each; as results the id is given once, by its best. An empty table matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from .cells import runs, whole_runs

PER_CELL, CELLS_MOST, PROBES, RERANK = 256, 65536, 16, 64
SAMPLE_PER_CELL, ROUNDS, CODES, PARTS = 64, 5, 256, 8
BLOCK = 4096
#: Vectors, and queries, that a task of the exact search holds at most; bundles of cells that it has at least, if they are of BUNDLE_LEAST vectors.
#: Wide vectors: 2^22 numbers instead.
BUNDLE, BUNDLE_LEAST, BUNDLES = 65536, 1024, 32
#: Beyond rounding: of scores, and of angles, whose cosines near 1 are within rounding for up to 1e-8.
SLACK, ANGLE = 1e-9, 1e-6
#: Folders of a stored index.
BUCKETS = 256


def given_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, n): vectors as arrays of doubles and their lengths, those that match nothing left out."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    good = rows.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").withColumn("n", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    return good.where("n > 0 AND n < double('infinity')").select("id", "v", "n")


def unit_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): unit vectors as arrays of doubles, those that match nothing left out."""
    return given_rows(vectors, vec_id, embedding).select("id", F.expr("transform(v, x -> x / n)").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), dim)


def _closest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """(rows, n) indices of the nearest centres by Euclidean distance, nearest first."""
    out = np.zeros((len(x), n), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    for at in range(0, len(x), step):
        score = x[at : at + step] @ centres.T - half
        if n == 1:
            out[at : at + step, 0] = score.argmax(axis=1)
        else:
            best = np.argpartition(-score, min(n, score.shape[1]) - 1, axis=1)[:, :n]
            out[at : at + step] = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable"), axis=1)
    return out


@dataclass
class Model:
    """Centres (cells, dim) and the entries (parts, CODES, width) of their residuals' codes."""

    centres: np.ndarray
    entries: np.ndarray

    def widths(self) -> list[slice]:
        edges = np.linspace(0, self.centres.shape[1], len(self.entries) + 1).round().astype(int)
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cell]
        return np.stack([_closest(rest[:, w], e[:, : w.stop - w.start])[:, 0] for w, e in zip(self.widths(), self.entries)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) approximate cosines."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for k, (w, e) in enumerate(zip(self.widths(), self.entries)):
            out += (q[:, w] @ e[:, : w.stop - w.start].T)[:, codes[:, k]]
        return out


def _means(sample: DataFrame, dim: int, groups: int, assign) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of assign(x) = [(group, values)] over the sample, each task's share added up before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for group, values in assign(x):
                order = np.argsort(group, kind="stable")
                begin, _ = runs([group[order]])
                sums = np.add.reduceat(np.hstack([values, np.ones((len(values), 1))])[order], begin, axis=0) if len(order) else np.zeros((0, 0))
                for g, s in zip(group[order][begin].tolist(), sums):
                    total[g] = total[g] + s if g in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], ["g", "s"])

    parts = sample.select("v").mapInArrow(run, "g long, s array<double>")
    # Sums by position, without a function of our own: arrays of one group are added entry by entry.
    added = parts.select("g", F.posexplode("s").alias("k", "x")).groupBy("g", "k").agg(F.sum("x").alias("x")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("s"))
    found = {r["g"]: [e["x"] for e in r["s"]] for r in added.collect()}
    width = len(next(iter(found.values()))) - 1 if found else dim
    sums, counts = np.zeros((groups, width)), np.zeros(groups)
    for g, s in found.items():
        sums[g], counts[g] = s[:-1], s[-1]
    return sums, counts


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", per_cell: int = PER_CELL, parts: int = PARTS, rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """Centres and codes for a table of vectors; the length of most of them (ties: the shorter) is the index's. None without any vector."""
    rows = unit_rows(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return None
    dim, n = sizes["dim"], sizes["n"]
    cells = int(max(1, min(CELLS_MOST, n // per_cell)))
    wanted = max(SAMPLE_PER_CELL * cells, 4 * CODES)
    own = rows.where(F.size("v") == dim)
    chosen = own.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.2 * wanted / n) * (1 << 30))) if wanted < n else own
    sample = chosen.select("id", "v").persist(StorageLevel.MEMORY_AND_DISK)
    first = sample.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "v").limit(max(cells, CODES)).collect()
    start = np.array([r["v"] for r in first])
    centres = start[:cells]
    for _ in range(rounds):
        sums, counts = _means(sample, dim, len(centres), lambda x, c=centres: [(_closest(x, c)[:, 0], x)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        # A cell without vectors, or whose vectors cancel out, stays where it was.
        centres = np.where((counts[:, None] > 0) & (norm > 1e-12), sums / np.maximum(norm, 1e-12), centres)
    edges = np.linspace(0, dim, min(parts, dim) + 1).round().astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    width = max(w.stop - w.start for w in cuts)
    rest = start[:CODES] - centres[_closest(start[:CODES], centres)[:, 0]]
    entries = np.zeros((len(cuts), CODES, width))
    for k, w in enumerate(cuts):
        entries[k, :, : w.stop - w.start] = np.resize(rest[:, w], (CODES, w.stop - w.start))

    def by_part(x: np.ndarray, now: np.ndarray):
        left = x - centres[_closest(x, centres)[:, 0]]
        for k, w in enumerate(cuts):
            padded = np.zeros((len(x), width))
            padded[:, : w.stop - w.start] = left[:, w]
            yield _closest(padded, now[k])[:, 0] + k * CODES, padded

    for _ in range(rounds):
        sums, counts = _means(sample, dim, len(cuts) * CODES, lambda x, e=entries: by_part(x, e))
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], entries.reshape(-1, width))
        entries = moved.reshape(entries.shape)
    sample.unpersist()
    return Model(centres, entries)


def index(vectors: DataFrame, model: Model | None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(bucket, cell, id, code, v) of every vector that can match, v as given."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], "bucket int, cell int, id long, code binary, v array<double>")
    dim = model.centres.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # CELLS_MOST centres at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), dim) / batch.column(2).to_numpy()[:, None]
            cell = _closest(x, m.centres)[:, 0] if len(x) else np.zeros(0, dtype=np.int64)
            codes = m.codes(x, cell) if len(x) else np.zeros((0, 1), dtype=np.uint8)
            raw, step = codes.tobytes(), codes.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(cell % BUCKETS, pa.int32()), pa.array(cell, pa.int32()), batch.column(0), pa.array([raw[i * step : (i + 1) * step] for i in range(len(x))], pa.binary()), batch.column(1)], ["bucket", "cell", "id", "code", "v"])

    rows = given_rows(vectors, vec_id, embedding).where(F.size("v") == dim)
    return rows.mapInArrow(run, "bucket int, cell int, id long, code binary, v array<double>")


def probes(queries: DataFrame, model: Model, vec_id: str = "vec_id", embedding: str = "embedding", n: int = PROBES) -> DataFrame:
    """(cell, q, qn, qv): the nearest cells of each query, which has a number of its own."""
    dim, n = model.centres.shape[1], min(n, len(model.centres))
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if len(x):
                cell = _closest(x, shared.value.centres, n)
                at = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel(), pa.int32()), batch.column(0).take(at), batch.column(2).take(at), batch.column(1).take(at)], ["cell", "q", "qn", "qv"])

    rows = unit_rows(queries, vec_id, embedding).where(F.size("v") == dim).withColumn("qn", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "cell int, q long, qn long, qv array<double>")


def search(
    queries: DataFrame, indexed: DataFrame, model: Model | None, threshold: float = -1.0, k: int = 1, n_probes: int = PROBES, rerank: int = RERANK, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """(query_id, vec_id, score, rank): of each query its k nearest others of a cosine of threshold or more, among the rerank best by code."""
    spark = queries.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    rerank = max(rerank, k)
    asked = cut(probes(queries, model, vec_id, embedding, n_probes))
    # Both are tables of cells: CELLS_MOST rows at most.
    load = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("lanes")))
    held = indexed.select("cell", "id", "code").join(load, "cell")
    size = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces")))
    members = held.join(size, "cell").select("cell", F.expr("int(pmod(xxhash64(id), pieces))").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("side"), "id", F.lit(None).cast("long").alias("qn"), "code", F.lit(None).cast("array<double>").alias("qv"))
    visitors = asked.join(load, "cell").join(size, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.expr("int(pmod(xxhash64(qn), lanes))").alias("lane"), F.lit(1).alias("side"), F.col("q").alias("id"), "qn", F.lit(None).cast("binary").alias("code"), "qv")
    shared, dim = spark.sparkContext.broadcast(model), model.centres.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["cell", "piece", "lane"], 16_384):
            cell, side, ids = (table.column(c).to_numpy() for c in ("cell", "side", "id"))
            begin, end = runs([table.column(c).to_numpy() for c in ("cell", "piece", "lane")])
            for a, b in zip(begin.tolist(), end.tolist()):
                first = a + int(np.searchsorted(side[a:b], 1))
                if first in (a, b):
                    continue
                codes = np.frombuffer(b"".join(table.column("code").slice(a, first - a).to_pylist()), dtype=np.uint8).reshape(first - a, -1)
                q = _matrix(table.column("qv").slice(first, b - first).combine_chunks(), dim)
                who, number = ids[first:b], table.column("qn").slice(first, b - first).to_numpy()
                for at in range(0, len(q), 64):
                    score = shared.value.scores(q[at : at + 64], int(cell[a]), codes)
                    score[who[at : at + 64, None] == ids[None, a:first]] = -np.inf
                    take = min(rerank, score.shape[1])
                    best = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    value = np.take_along_axis(score, best, axis=1).ravel()
                    p = np.repeat(number[at : at + 64], take)
                    some = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([pa.array(p[some]), pa.array(ids[a:first][best.ravel()][some]), pa.array(value[some]), pa.array(np.full(int(some.sum()), cell[a], dtype=np.int32))], ["qn", "id", "approx", "cell"])

    dealt = members.unionByName(visitors).repartition("cell", "piece", "lane").sortWithinPartitions("cell", "piece", "lane", "side")
    found = dealt.mapInArrow(scan, "qn long, id long, approx double, cell int")
    best = Window.partitionBy("qn").orderBy(F.desc("approx"), "id")
    near = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rerank).select("qn", "id", "cell")
    wanted = near.join(asked.select("qn", "q", "qv").dropDuplicates(["qn"]), "qn").select("cell", "id", "q", "qv").distinct()
    exact = indexed.select("cell", "id", "v").join(wanted, ["cell", "id"]).withColumn("score", F.expr("aggregate(zip_with(qv, v, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    scored = exact.groupBy("q", "id").agg(F.max("score").alias("score")).where(F.col("score") >= threshold)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up entry by entry: equal vectors have equal ones, wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _few_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that can't be among anyone's k best others: of equal vectors the k + 1 smallest ids stay."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    factors = np.random.default_rng(1).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mark = ((bits ^ (bits >> np.uint64(31))) * factors).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, mark))
    begin, end = runs([mark[order]])
    if (end - begin).max(initial=0) <= k + 1:
        return np.arange(len(ids))
    first = np.repeat(begin, end - begin)
    equal = (bits[order] == bits[order[first]]).all(axis=1)
    # Of the rows equal to their run's first, those with a new id count.
    same = np.flatnonzero(equal)
    fresh = runs([first[same], ids[order[same]]])[0]
    begin, end = runs([first[same[fresh]]])
    few = fresh[np.arange(len(fresh)) - np.repeat(begin, end - begin) <= k]
    return order[np.concatenate([np.flatnonzero(~equal), same[few]])]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each q, an id once; of equal scores the smaller id."""
    order = np.lexsort((-score, ids, q))
    order = order[runs([q[order], ids[order]])[0]]
    order = order[np.lexsort((ids[order], -score[order], q[order]))]
    begin, end = runs([q[order]])
    return order[np.arange(len(order)) - np.repeat(begin, end - begin) < k]


def exact(
    queries: DataFrame, indexed: DataFrame, model: Model | None, threshold: float = -1.0, k: int = 1, n_probes: int = PROBES, rerank: int = RERANK, vec_id: str = "vec_id", embedding: str = "embedding",
    bundle: int = BUNDLE, least: int = BUNDLE_LEAST,
) -> DataFrame:
    """(query_id, vec_id, score, rank) like search, none missed; indexed is read several times.

    A vector v of a cell with centre c is at least |angle(q, c) - angle(v, c)| from q. So a query is compared with the cells whose range of angles comes within the
    angle of its k-th best score so far, or the threshold's. Cells are dealt in bundles of at most `bundle` vectors, larger ones in pieces; of each the k best are told.
    Scores are dot products of the given vectors over the root of their squared lengths' product, added up in the entries' order.
    """
    spark = queries.sparkSession
    if model is None:
        return search(queries, indexed, None)
    dim = model.centres.shape[1]
    bundle = max(1, min(bundle, (1 << 22) // dim))
    before = search(queries, indexed, model, threshold, k, n_probes, rerank, vec_id, embedding).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    asked = given_rows(queries, vec_id, embedding).where(F.size("v") == dim).join(before, "id", "left")
    asked = cut(asked.select(F.monotonically_increasing_id().alias("qn"), "id", (F.coalesce("score", F.lit(float(threshold))) - SLACK).alias("floor"), "v"))
    centres = _units(model.centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, x = batch.column(0).to_numpy(), _units(_matrix(batch.column(1), dim))
            angle = np.arccos(np.clip((x * shared.value[0][cell]).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(angle)], ["cell", "angle"])

    shared = spark.sparkContext.broadcast((centres,))
    found = indexed.select("cell", "v").mapInArrow(measure, "cell int, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell").collect()
    # Tables of cells, CELLS_MOST rows at most: bundles of successive cells, and pieces of those that are larger than one.
    most = max(1, min(bundle, max(least, -(-sum(r["n"] for r in found) // BUNDLES))))
    start, pieces, held = [], [], 0
    for k_, r in enumerate(found):
        alone = r["n"] > most
        if k_ == 0 or alone or pieces[-1] > 1 or held + r["n"] > most:
            start.append(start[-1] + pieces[-1] if start else 0)
            held = 0
        else:
            start.append(start[-1])
        pieces.append(-(-r["n"] // most))
        held += r["n"]
    cells = np.array([r["cell"] for r in found], dtype=np.int64)
    low, high = (np.array([r[c] for r in found]) for c in ("low", "high"))
    group, _ = runs([np.array(start, dtype=np.int64)])
    to, parts = np.array(start, dtype=np.int64)[group], np.array(pieces, dtype=np.int64)[group]
    known = spark.sparkContext.broadcast((centres, cells, low, high, group, to, parts))

    def within(x: np.ndarray, floor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(queries, cells) whether cells at the positions may hold what is wanted."""
        mid, number, nearest, farthest = known.value[:4]
        angle = _angles(x, mid[number[at]])
        reach = np.arccos(np.clip(floor, -1, 1))[:, None] + ANGLE
        return (angle - farthest[at] <= reach) & (nearest[at] - angle <= reach)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, first, base, n = known.value[1], *known.value[4:]
        step = max(1, (1 << 21) // max(1, len(every)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(every) else 0, step):
                batch = whole.slice(at, step)
                good = within(_units(_matrix(batch.column(3), dim)), batch.column(2).to_numpy(), np.arange(len(every)))
                row, g = np.nonzero(np.logical_or.reduceat(good, first, axis=1))
                times = n[g]
                place = np.repeat(base[g] - np.cumsum(times) + times, times) + np.arange(times.sum())
                take = pa.array(np.repeat(row, times))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *(batch.column(c).take(take) for c in range(4))], ["bundle", "qn", "id", "floor", "v"])

    lanes = max(1, -(-asked.count() // bundle))
    places = F.broadcast(spark.createDataFrame([(int(c), int(b), int(p)) for c, b, p in zip(cells, start, pieces)], "cell int, start int, pieces int"))
    members = indexed.join(places, "cell").select(F.expr("start + int(pmod(xxhash64(id), pieces))").alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "cell", F.lit(None).cast("long").alias("qn"), "id", F.lit(None).cast("double").alias("floor"), "v")
    visitors = asked.mapInArrow(deal, "bundle int, qn long, id long, floor double, v array<double>").select("bundle", F.expr(f"int(pmod(xxhash64(qn), {lanes}))").alias("lane"), F.lit(-1).alias("cell"), "qn", "id", "floor", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["bundle", "lane"], 4096):
            cell, ids, floors = (table.column(c).to_numpy() for c in ("cell", "id", "floor"))
            begin, end = runs([table.column(c).to_numpy() for c in ("bundle", "lane")])
            for a, b in zip(begin.tolist(), end.tolist()):
                first = a + int(np.searchsorted(cell[a:b], 0))
                if first in (a, b):
                    continue
                given = _matrix(table.column("v").slice(a, first - a).combine_chunks(), dim)
                who, floor, unit, own = ids[a:first], floors[a:first], _units(given), _in_order(given, given)
                for s, e in zip(*(first + x for x in runs([cell[first:b]]))):
                    x = _matrix(table.column("v").slice(s, e - s).combine_chunks(), dim)
                    stay = _few_copies(ids[s:e], x, k)
                    x, names = x[stay], ids[s:e][stay]
                    other, length = _units(x).T, _in_order(x, x)
                    # Of k ids the best rows are among so many.
                    deep = min(len(x), k * int(np.unique(names, return_counts=True)[1].max()))
                    asking = np.flatnonzero(within(unit, floor, np.searchsorted(known.value[1], cell[s : s + 1]))[:, 0])
                    step = max(1, (1 << 20) // len(x))
                    for at in range(0, len(asking), step):
                        some = asking[at : at + step]
                        score = unit[some] @ other
                        score[who[some, None] == names[None]] = -np.inf
                        least_ = np.maximum(-np.partition(-score, deep - 1, axis=1)[:, deep - 1] - SLACK, floor[some])
                        p, r = np.nonzero(score >= least_[:, None])
                        p = some[p]
                        square = own[p] * length[r]
                        normal = np.isfinite(square) & (square > 1e-300)
                        value = np.clip(_in_order(given[p], x[r]) / np.where(normal, np.sqrt(square), np.sqrt(own[p]) * np.sqrt(length[r])), -1, 1)
                        right = np.flatnonzero(value >= threshold)
                        top = right[_best(who[p[right]], names[r[right]], value[right], k)]
                        if len(top):
                            yield pa.RecordBatch.from_arrays([pa.array(who[p[top]]), pa.array(names[r[top]]), pa.array(value[top])], ["q", "id", "score"])

    dealt = members.unionByName(visitors).repartition("bundle", "lane").sortWithinPartitions("bundle", "lane", "cell")
    scored = dealt.mapInArrow(compare, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


def save(indexed: DataFrame, model: Model, path: str) -> None:
    """The index under path: rows by bucket of cells, the model beside them."""
    spark = indexed.sparkSession
    indexed.repartition("bucket").sortWithinPartitions("bucket", "cell").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    rows = [("centre", k, c.tolist()) for k, c in enumerate(model.centres)] + [("entry", k, e.ravel().tolist()) for k, e in enumerate(model.entries)]
    spark.createDataFrame(rows, "kind string, k int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "k").collect()
    entries = [np.array(r["v"]).reshape(CODES, -1) for r in rows if r["kind"] == "entry"]
    return Model(np.array([r["v"] for r in rows if r["kind"] == "centre"]), np.array(entries))


def search_stored(queries: DataFrame, path: str, threshold: float = -1.0, k: int = 1, n_probes: int = PROBES, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """search over a stored index: only the folders of the queries' cells are read."""
    spark = queries.sparkSession
    model = load(spark, path)
    touched = [r["b"] for r in probes(queries, model, vec_id, embedding, n_probes).select(F.expr(f"cell % {BUCKETS}").alias("b")).distinct().collect()]
    rows = spark.read.schema("cell int, id long, code binary, v array<double>, bucket int").parquet(f"{path}/rows").where(F.col("bucket").isin(touched))
    return search(queries, rows, model, threshold, k, n_probes, rerank, vec_id, embedding)


def add(vectors: DataFrame, path: str, vec_id: str = "vec_id", embedding: str = "embedding") -> None:
    """Appends vectors to a stored index, with its model as it is."""
    index(vectors, load(vectors.sparkSession, path), vec_id, embedding).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
