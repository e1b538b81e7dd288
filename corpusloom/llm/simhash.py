"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at `max_bits` = 4 or fewer differing bits. Two 23-bit segments A and B and an 18-bit rest C
make up a fingerprint. The perfect binary Golay code has exactly one codeword within 3 bits of each 23-bit word.
The keys of a segment are the indices of all codewords within 4 bits of it (one key, or six): two segments that
differ in at most 2 bits have a word between them that is within 1 bit of both, whose codeword is a key of both. By
pigeonhole, of at most 4 errors

* either A and B have at most 2 each: a pair of keys, one of A's and one of B's, is shared;
* or A has at least 3, so the other 41 bits have at most 1 and one of their halves is equal;
* or B has at least 3, and likewise for the 41 bits beside B.

So every linked pair shares a key and no link is lost. Rows are joined on the keys (at most 40 per distinct
fingerprint), verified by exact bit count, and linked groups found as connected components.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any other. Equal
fingerprints are one node, so groups of exact copies cost one row. A null doc_id takes no part in choosing the
smallest id. Repeated rows and ties have one fingerprint and component. Very long texts are read whole; their bits are counted in steps.
Only id and text are read, so other columns cannot clash; keep_one gives all columns back as they are. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .arrowtext import LOWER, NOT_SPACE, chunks, column_of, words
from .graphs import cells, components, lowest, whole_runs
from .sparkutil import cut, fresh

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Distinct fingerprints of one key that are compared in one cell; larger buckets are dealt to several.
BLOCK = 4096
#: A fingerprint with more than one row in so many is frequent; there are fewer than so many of them, whatever the input.
FREQUENT = 1000
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEGMENT = (1 << 23) - 1


def _remainder(x: np.ndarray) -> np.ndarray:
    """23-bit words modulo the code's generator polynomial: their syndromes."""
    rest = x.astype(np.uint32)
    for k in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(k) & np.uint32(1), np.uint32(_GENERATOR << (k - 11)), np.uint32(0))
    return rest


def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome: the errors (23-bit, up to 6) that lead to a codeword within 4 bits, and their number."""
    light = np.array([sum(1 << k for k in bits) for n in range(5) for bits in combinations(range(23), n)], dtype=np.uint32)
    errors, number = np.zeros((2048, 6), dtype=np.uint32), np.zeros(2048, dtype=np.int64)
    for e, s in zip(light.tolist(), _remainder(light).tolist()):
        errors[s, number[s]] = e
        number[s] += 1
    return errors, number


_KEYS: list = []


def _segment_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords near each segment, and how many of them count."""
    if not _KEYS:
        _KEYS.extend(golay_keys())
    errors, number = _KEYS
    rest = _remainder(segment)
    # The code is cyclic and its generator monic, so a codeword's high 12 bits are its index.
    return (segment[:, None] ^ errors[rest]) >> np.uint32(11), number[rest]


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    x = fingerprints.astype(np.uint64)
    a, b, c = (x & np.uint64(_SEGMENT)).astype(np.uint32), (x >> np.uint64(23) & np.uint64(_SEGMENT)).astype(np.uint32), (x >> np.uint64(46)).astype(np.uint64)
    (ka, na), (kb, nb) = _segment_keys(a), _segment_keys(b)
    rows, keys = [], []
    everyone = np.arange(len(x))
    for i in range(6):
        for j in range(6):
            some = np.flatnonzero((na > i) & (nb > j))
            rows.append(some)
            keys.append((ka[some, i].astype(np.int64) << 12) | kb[some, j].astype(np.int64))
    for tag, segment in ((1, b), (2, a)):
        beside = segment.astype(np.uint64) | (c << np.uint64(23))
        for half, part in ((0, beside & np.uint64((1 << 20) - 1)), (1, beside >> np.uint64(20))):
            rows.append(everyone)
            keys.append((part.astype(np.int64) << 3) | (np.int64(2 * tag + half - 1) << 60) | 1)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_texts(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    data = LOWER[data]
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets, NOT_SPACE)
    out = np.zeros(n, dtype=np.uint64)
    if not len(starts):
        return out
    # One blank after each word: shingles are then slices of one buffer.
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    where = np.arange(int((size + 1).sum())) - np.repeat(to - starts, size + 1)
    packed = data[np.minimum(where, len(data) - 1)]
    packed[to + size] = 32
    buffer = packed.tobytes()
    counts = np.bincount(text, minlength=n)
    first = np.cumsum(counts) - counts
    k = np.arange(len(starts))
    begins = k + shingle <= (first + counts)[text]
    begins |= (k == first[text]) & (counts[text] < shingle)
    begin = k[begins]
    end = np.minimum(begin + shingle, (first + counts)[text[begin]]) - 1
    pieces = [buffer[s:e] for s, e in zip(to[begin].tolist(), (to[end] + size[end]).tolist())]
    h = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), dtype=np.uint64, count=len(pieces))
    return majority(h, text[begin], n)


def majority(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of n texts from the hashes of their shingles, text by text: a bit is 1 if set in over half of them."""
    per = np.bincount(owner, minlength=n)
    ones = np.zeros((n, 64), dtype=np.int64)
    # Short steps: the sums take their bits as longs.
    for at in range(0, len(h), 1 << 13):
        part, whose = h[at : at + (1 << 13)], owner[at : at + (1 << 13)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        np.add.at(ones, whose[new], np.add.reduceat(bits, new, axis=0, dtype=np.int64))
    return np.packbits(2 * ones > per[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """docs (or its columns keep) with the fingerprint as a signed long in column to."""
    kept = docs.columns if keep is None else keep
    source = docs.select(*kept, text) if text not in kept else docs.select(*kept)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(to, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(column_of(batch, text)):
                found = fingerprint_texts(data, offsets, shingle).view(np.int64)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(column_of(rows, c) for c in kept), pa.array(found)], [*kept, to])

    return source.mapInArrow(run, schema)


def exploded(distinct: DataFrame, member: str = "fp") -> DataFrame:
    """(key, member) of all keys of distinct(fp, member), longs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, who = column_of(batch, "fp").to_numpy(), column_of(batch, member).to_numpy()
            for at in range(0, len(fp), 1 << 12):
                rows, keys = fuzzy_keys(fp[at : at + (1 << 12)].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(who[at + rows])], ["key", member])

    return distinct.select("fp", *(c for c in (member,) if c != "fp")).mapInArrow(explode, f"key long, {member} long")


def _forest(fp: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Tree edges of the graph of links among fp: each search step takes the reached rows out of those left."""
    left = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            k = stack.pop()
            near = np.bitwise_count(fp[left] ^ fp[k]) <= most
            if near.any():
                reached = left[near].tolist()
                a += [k] * len(reached)
                b += reached
                stack += reached
                left = left[~near]
    return a, b


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that span the groups of linked fingerprints, from the distinct fingerprints in column fp.

    Each cell of a bucket gives a forest and not all its pairs: the same components with fewer rows than members.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the keys find up to 4 differing bits")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["key", "i", "j"]):
            key, i, j, fp = (run.column(c).to_numpy() for c in ("key", "i", "j", "fp"))
            fp = fp.view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.concatenate([new, [len(key)]]))
            us, vs = [], []
            group = np.repeat(np.arange(len(new)), size)
            small = size <= 32
            rows = np.flatnonzero(small[group])
            # All small cells at once: row k against row k + shift of the same cell.
            for shift in range(1, 32):
                rows = rows[rows + shift < len(key)]
                rows = rows[group[rows] == group[rows + shift]]
                if not len(rows):
                    break
                good = rows[np.bitwise_count(fp[rows] ^ fp[rows + shift]) <= max_bits]
                us.append(fp[good])
                vs.append(fp[good + shift])
            for g in np.flatnonzero(~small).tolist():
                part = slice(new[g], new[g] + size[g])
                a, b = _forest(fp[part], max_bits)
                us.append(fp[part][a])
                vs.append(fp[part][b])
            if us:
                u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    dealt = cells(exploded(distinct), "key", "fp", block, alone=True)
    parts = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return parts.select("key", "i", "j", "fp").mapInArrow(verify, "u long, v long").distinct()


def by_fingerprint(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, n, root, component_id) of each distinct fingerprint of marked(doc_id, fp): its rows, its group and the group's smallest id."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(distinct, max_bits))
    return lowest(distinct, roots, "fp", "low").select("fp", "n", "root", "component_id")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest doc_id of its group.

    Rows of frequent fingerprints stay where they are, so a group of copies of a third of all rows is no task of its own.
    """
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    found = cut(by_fingerprint(marked, max_bits))
    frequent = F.col("n") * FREQUENT > marked.count()
    few = found.where(frequent).select(F.col("fp").alias("_fp"), "component_id")
    rows = marked.join(F.broadcast(few), F.col("fp") == F.col("_fp"), "left")
    rest = rows.where("_fp IS NULL").select("doc_id", "fp").join(found.where(~frequent).select("fp", "component_id"), "fp")
    return rows.where("_fp IS NOT NULL").select("doc_id", "fp", "component_id").unionByName(rest)


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, with all columns of docs: that of the smallest id.

    If several rows of the group have that id, one of them stays. A group in which no row has an id keeps one row as well.
    """
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    counted = marked.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    # Of each group: the fingerprint and id of the row that stays, and how many rows have both.
    least = cut(counted.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")).alias("least")))
    roots = components(links(least, max_bits))
    whole = least.join(roots, least.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("k"))
    kept = cut(whole.select("k.fp", "k.doc_id", "k.n"))
    mark, low, n, fp = fresh(docs, "mark", "low", "n", "fp")
    rows = fingerprints(docs, text, to=fp).join(kept.select(F.col("fp").alias(mark), F.col("doc_id").alias(low), F.col("n").alias(n)), (F.col(fp) == F.col(mark)) & F.col(doc_id).eqNullSafe(F.col(low)))
    once = rows.where(F.col(n) == 1).select(docs.columns)
    again = rows.where(F.col(n) > 1).dropDuplicates([fp]).select(docs.columns)
    return once.unionByName(again)
