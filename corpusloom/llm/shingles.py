"""Near-dedup by exact Jaccard similarity of word shingles, with candidates from SimHash fingerprints by Golay keys and from MinHash bands.

A text is the set of its shingles of SHINGLE words (lower case, cut at white space); two texts are near copies if their sets have a
Jaccard similarity of THRESHOLD or more. First come op8's links over these shingles: sets whose SimHash fingerprints its Golay keys find
within four bits are candidates. At the threshold some ten bits differ, so the rest come by BANDS keys of ROWS minima each: a pair at the threshold shares one with probability 1 - (1 - 0.8^5)^20 = 0.9996, a closer one more surely. Each text is shingled once
for its fingerprint, its bands and its sketch, 16 bits of each minimum.
Rows of a bucket are told apart by their sketches: those that agree in fewer minima than a pair at the threshold does, less 4.5 standard deviations, are not
compared. What is left joins texts to families; a family's texts are brought together once and compared by exact sets. Groups are connected components.

Texts with equal sets are one node. Buckets with the same members are looked at once; one of more than BLOCK members, or a family of more than CELL shingles, is dealt to
cells of piece against piece, so a cell holds at most 2 * CELL shingles unless two texts have more. A cell gives a forest and not all its pairs.

Edge cases: a text of fewer words is one shingle; null or empty texts, or ones of white space, are one group. Very long texts are read whole. A null doc_id takes no
part in choosing the smallest id. Of rows that repeat an id and a text one is kept; of different texts with one id and one set, that of the smaller hash. Ties at the
threshold are near copies. Columns of any names pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrowtext import LOWER, NOT_SPACE, chunks, column_of, mix, spans_hash, words
from .graphs import cells, components, runs, whole_runs
from .sparkutil import cut, fresh

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
SEED = 42
#: Texts of one bucket whose sketches are compared in one cell, and shingles of one family whose sets are; larger ones are dealt to several.
BLOCK, CELL = 1024, 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text): the distinct shingles of whole texts, text by text, sorted within each."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, text = words(data, offsets, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    word = spans_hash(data, starts, ends)
    counts = np.bincount(text, minlength=n)
    first = np.cumsum(counts) - counts
    k = np.arange(len(starts))
    last = (first + counts)[text]
    begin = np.flatnonzero((k + shingle <= last) | ((k == first[text]) & (counts[text] < shingle)))
    h = word[begin]
    for d in range(1, shingle):
        at = begin + d
        more = at < last[begin]
        h = np.where(more, mix(h * _STEP + word[np.minimum(at, len(word) - 1)]), h)
    owner = text[begin]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return h[new], np.bincount(owner[new], minlength=n)


def set_ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; zero for the empty one."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h * _STEP), dtype=np.uint64)])
    ends = np.cumsum(n)
    return np.where(n > 0, mix(total[ends] - total[ends - n] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def fingerprints(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """SimHash fingerprints of sets as signed longs, null for the empty one."""
    fp = simhash.majority(h, np.repeat(np.arange(len(n)), n), len(n)).view(np.int64)
    return pa.array(fp, mask=n == 0)


def minima(h: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """(sets that are not empty, bands * rows) smallest hashes by as many functions."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (bands * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = (np.cumsum(n) - n)[n > 0]
    out = np.zeros((len(at), bands * rows), dtype=np.uint64)
    if len(at):
        for k, (a, c) in enumerate(factors):
            out[:, k] = np.minimum.reduceat(h * a + c, at)
    return out


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands) keys of minima."""
    rows = least.shape[1] // max(1, bands)
    out = np.zeros((len(least), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(least), np.uint64(b + 1))
        for k in range(b * rows, (b + 1) * rows):
            key = mix(key * _STEP + least[:, k])
        out[:, b] = key
    return out.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """(sets, minima) 16 bits of each."""
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch_limit(threshold: float = THRESHOLD, size: int = BANDS * ROWS) -> int:
    """Equal minima of two sketches from which on their texts are compared."""
    return max(1, math.floor(size * threshold - 4.5 * math.sqrt(size * threshold * (1 - threshold))))


def _tree(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Tree edges of a graph of n nodes: each search step takes the reached ones out of those left. near(k, left): which of left k reaches."""
    left = np.arange(n)
    a: list[int] = []
    b: list[int] = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            k = stack.pop()
            hit = near(k, left)
            if hit.any():
                reached = left[hit].tolist()
                a += [k] * len(reached)
                b += reached
                stack += reached
                left = left[~hit]
    return a, b


def _forest(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Tree edges of the graph of near copies."""
    size = np.array([len(s) for s in sets])
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(len(every), dtype=bool)

    def near(k: int, left: np.ndarray) -> np.ndarray:
        own = code[first[k] : first[k] + size[k]]
        mark[own] = True
        n = size[left]
        at = np.cumsum(n) - n
        shared = np.add.reduceat(mark[code[np.arange(n.sum()) + np.repeat(first[left] - at, n)]], at, dtype=np.int64)
        mark[own] = False
        return shared >= threshold * (n + size[k] - shared) - 1e-9

    return _tree(len(sets), near)


def _cells(run: pa.Table) -> Iterator[tuple[int, int]]:
    """(begin, end) of the cells of two rows and more."""
    begin, end = runs([run.column(c).to_numpy() for c in ("key", "i", "j")])
    yield from ((s, e) for s, e in zip(begin.tolist(), end.tolist()) if e - s > 1)


def families(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, root): sets that may be near copies, by fingerprints, keys and sketches of classes(sid, fp, keys, sketch)."""
    keys = classes.select("sid", F.explode("keys").alias("key"))
    # op8's links of distinct fingerprints, each by its smallest set, with which the other sets of the same fingerprint are linked.
    marked = classes.where("fp IS NOT NULL").select("sid", "fp")
    low = cut(marked.groupBy("fp").agg(F.min("sid").alias("low")))
    side = lambda c: low.select(F.col("fp").alias(c), F.col("low").alias(f"_{c}"))
    by_bits = simhash.links(low).join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    by_bits = by_bits.unionByName(marked.join(low, "fp").where("sid <> low").select(F.col("sid").alias("u"), F.col("low").alias("v")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.min("sid").alias("least"), F.max("sid").alias("most")).where("n > 1")
    # Near copies share most of their bands: buckets with the same members are one.
    once = shared.groupBy("n", "x", "least", "most").agg(F.min("key").alias("key")).select("key")
    limit = sketch_limit(threshold)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["key", "i", "j"], 4096):
            sid = run.column("sid").to_numpy()
            sketch = np.frombuffer(b"".join(run.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(sid), -1)
            us, vs = [], []
            for s, e in _cells(run):
                own = sketch[s:e]
                a, b = _tree(e - s, lambda k, left, own=own: (own[left] == own[k]).sum(axis=1) >= limit)
                us.append(sid[s:e][a])
                vs.append(sid[s:e][b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    dealt = cells(keys.join(once, "key"), "key", "sid", block).select("key", "i", "j", "sid").join(classes.select("sid", "sketch"), "sid")
    parts = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")
    return components(by_bits.unionByName(parts.select("key", "i", "j", "sid", "sketch").mapInArrow(alike, "u long, v long")))


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that span the groups of near copies among classes(sid, low, hash, size, fp, keys, sketch); docs(doc_id, text, hash) has their texts."""
    found = cut(families(classes, threshold, block).withColumnsRenamed({"node": "sid", "root": "key"}).join(classes.select("sid", "low", "hash", "size"), "sid"))
    pieces = found.groupBy("key").agg(F.ceil(F.sum("size") / cell).cast("int").alias("_c"))
    dealt = found.join(pieces, "key").withColumn("piece", F.expr("int(pmod(xxhash64(sid), _c))"))
    dealt = dealt.withColumn("_cell", F.explode(F.expr("transform(sequence(0, _c - 1), q -> struct(least(piece, q) AS i, greatest(piece, q) AS j))"))).select("key", "_cell.i", "_cell.j", "sid")
    # By id and hash of the text: no text is shingled to find those that are wanted, and rows of a large group of copies are spread.
    texts = docs.join(found.select("sid", F.col("low").alias("_low"), F.col("hash").alias("_hash")), (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("sid", "text").dropDuplicates(["sid"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["key", "i", "j"], 256):
            sid = run.column("sid").to_numpy()
            us, vs = [], []
            for s, e in _cells(run):
                sets = []
                for _, _, data, offsets in chunks(run.column("text").slice(s, e - s)):
                    h, n = shingle_sets(data, offsets)
                    sets += np.split(h, np.cumsum(n)[:-1])
                a, b = _forest(sets, threshold)
                us.append(sid[s:e][a])
                vs.append(sid[s:e][b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    parts = dealt.join(texts, "sid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")
    return parts.select("key", "i", "j", "sid", "text").mapInArrow(verify, "u long, v long").distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK, cell: int = CELL, bands: int = BANDS) -> DataFrame:
    """One row of each group of near copies, with all columns of docs: that of the smallest id.

    bands: MinHash keys (up to BANDS); with none the candidates are the fingerprints' alone. If several rows have that id, one of them stays. A group in which no row has an id keeps one row as well.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(column_of(batch, "text")):
                h, n = shingle_sets(data, offsets)
                least = minima(h, n)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(least[:, : bands * ROWS], bands).ravel()))
                short = iter(sketches(least))
                sketch = pa.array([next(short).tobytes() if k else b"" for k in n.tolist()], pa.binary())
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([column_of(rows, "doc_id"), column_of(rows, "hash"), pa.array(set_ids(h, n)), pa.array(n), fingerprints(h, n), keys, sketch], ["doc_id", "hash", "sid", "size", "fp", "keys", "sketch"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    marked = cut(slim.mapInArrow(run, f"doc_id {kind}, hash long, sid long, size long, fp long, keys array<long>, sketch binary"))
    # Of each set: its smallest id, the hash of a text that has it, and how many rows have both.
    of_set = ("size", "fp", "keys", "sketch")
    counted = marked.groupBy("sid", "doc_id", "hash").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in of_set))
    least = counted.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")).alias("low"), *(F.first(c).alias(c) for c in of_set))
    classes = cut(least.select("sid", F.col("low.doc_id").alias("low"), F.col("low.hash").alias("hash"), F.col("low.n").alias("n"), *of_set))
    roots = components(links(slim, classes, threshold, block, cell))
    linked = classes.join(roots, classes.sid == roots.node, "left").select("sid", "low", "hash", "n", F.coalesce("root", "sid").alias("root"))
    chosen = linked.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "sid", "hash", "n")).alias("k"))
    mark, low, n, own = fresh(docs, "mark", "low", "n", "hash")
    chosen = cut(chosen.select(F.col("k.hash").alias(mark), F.col("k.low").alias(low), F.col("k.n").alias(n)))
    rows = docs.withColumn(own, F.xxhash64(F.col(text))).join(chosen, (F.col(own) == F.col(mark)) & F.col(doc_id).eqNullSafe(F.col(low)))
    once = rows.where(F.col(n) == 1).select(docs.columns)
    again = rows.where(F.col(n) > 1).dropDuplicates([own, low]).select(docs.columns)
    return once.unionByName(again)
