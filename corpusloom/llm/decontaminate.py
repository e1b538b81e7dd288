"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A window is `width`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Windows are found by
hash in one vectorised pass over whole texts and then verified word by word, so a hash collision is no hit.

The set is a few numbers a window (hash, place in one buffer of the items' normalised text, items), not a table of strings: about
30 bytes a word beside the text. A benchmark whose set would be larger than GROUP_BYTES is scanned in several rounds.

Edge cases: a null or empty text has no words and no hits; an item without words has no window; repeated items count
once per item_id; an item with a null id contributes windows, but no id; other columns pass
through unread; scan replaces those named like its results, the removing functions keep them.
Rows keep their multiplicity; equal rows have equal results, so there are no ties. Very long texts are read whole. An empty benchmark gives no
hits, an empty table of documents an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import ALNUM, LOWER, chunks, column_of, spans_hash, words
from .sparkutil import aside, cut, fresh, without

WIDTH = 13
#: Bytes of the set that is broadcast, about: WORD_BYTES for each word of the benchmark beside its text. A larger benchmark is scanned in several rounds.
GROUP_BYTES, WORD_BYTES = 48 << 20, 30
_FILTER_BITS = 22
_NEW = ("n_words", "hits", "items")


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words: a polynomial over the words' hashes."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


class _Windows:
    """Windows of one number of words, in the order of their hashes: distinct hashes, the windows of each, and the items of each window."""

    def __init__(self, n: int, h: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, buffer: bytes) -> None:
        by = np.argsort(h, kind="stable")
        h, begin, end, item = h[by], begin[by], end[by], item[by]
        # Windows with one hash are one text, but for collisions: those few stretches are told apart by their texts.
        same = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])]).astype(np.int32) if len(h) else np.zeros(0, dtype=np.int32)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        kind = np.zeros(len(h), dtype=np.int32)
        for k in np.flatnonzero(np.concatenate([[False], h[1:] == h[:-1]])).tolist():
            texts = [buffer[begin[f] : end[f]] for f in range(first[same[k]], k)]
            own = buffer[begin[k] : end[k]]
            if texts[0] != own:
                kind[k] = kind[first[same[k]] + texts.index(own)] if own in texts else 1 + max(kind[first[same[k]] : k])
        by = np.lexsort((item, kind, same))
        h, begin, end, item, kind, same = h[by], begin[by], end[by], item[by], kind[by], same[by]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (same[1:] != same[:-1]) | (kind[1:] != kind[:-1])
        other = new.copy()
        other[1:] |= item[1:] != item[:-1]
        window = np.cumsum(new) - 1
        self.n, self.hash, self.begin, self.end = n, h[new], begin[new], end[new]
        self.item = item[other]
        self.items = np.concatenate([[0], np.cumsum(np.bincount(window[other], minlength=int(new.sum())))]).astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.hash >> np.uint64(64 - _FILTER_BITS)] = True


class BenchmarkSet:
    """Windows of some benchmark items by number of words, over one buffer of their normalised texts."""

    def __init__(self, items: list[tuple[str | None, str | None]] | pa.Table, width: int = WIDTH) -> None:
        table = items if isinstance(items, pa.Table) else pa.table({"i": pa.array([i for i, _ in items], pa.string()), "t": pa.array([t for _, t in items], pa.string())})
        names = table.column("i").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        self.names = names.dictionary.to_pylist()
        # Items without a name have the number after the last, and no id.
        number = names.indices.fill_null(len(self.names)).to_numpy(zero_copy_only=False).astype(np.int32)
        buffers, parts = [], []
        done = 0
        for first, _, data, offsets in chunks(table.column("t")):
            data = LOWER[data]
            starts, ends, text = words(data, offsets, ALNUM)
            # The words with one blank after each.
            size = ends - starts
            to = np.cumsum(size + 1) - size - 1
            packed = data[np.minimum(np.arange(int((size + 1).sum())) - np.repeat(to - starts, size + 1), max(len(data) - 1, 0))] if len(size) else data[:0]
            packed[to + size] = 32
            h = spans_hash(packed, to, to + size) if len(size) else np.zeros(0, dtype=np.uint64)
            count = np.bincount(text, minlength=len(offsets) - 1)
            for n in np.unique(np.minimum(count[count > 0], width)).tolist():
                w = np.arange(max(0, len(starts) - n + 1))
                w = w[(text[w] == text[w + n - 1]) & (np.minimum(count[text[w]], width) == n)]
                parts.append((n, _windows(h, n)[w], (done + to[w]).astype(np.int32), (done + to[w + n - 1] + size[w + n - 1]).astype(np.int32), number[first + text[w]]))
            buffers.append(packed.tobytes())
            done += len(packed)
        self.buffer = b"".join(buffers)
        widths = sorted({p[0] for p in parts})
        self.by_width = {n: _Windows(n, *(np.concatenate([p[k] for p in parts if p[0] == n]) for k in (1, 2, 3, 4)), self.buffer) for n in widths}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
        """Number of words of each text; its hit words as spans (first word, end word, start byte, end byte); its items."""
        data = LOWER[data]
        starts, ends, text = words(data, offsets, ALNUM)
        n_words = np.bincount(text, minlength=len(offsets) - 1)
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if not len(starts):
            return n_words, spans, items
        h = spans_hash(data, starts, ends)
        hit = np.zeros(len(starts) + 1, dtype=np.int32)
        for n, known in self.by_width.items():
            w = _windows(h, n)
            near = np.flatnonzero(known.filter[w >> np.uint64(64 - _FILTER_BITS)])
            near = near[text[near] == text[near + n - 1]]
            left, right = np.searchsorted(known.hash, w[near]), np.searchsorted(known.hash, w[near], side="right")
            some = right > left
            found: dict[int, set[int]] = {}
            for k, a, b in zip(near[some].tolist(), left[some].tolist(), right[some].tolist()):
                own = b" ".join([data[x:y].tobytes() for x, y in zip(starts[k : k + n], ends[k : k + n])])
                for at in range(a, b):
                    if self.buffer[known.begin[at] : known.end[at]] == own:
                        hit[k] += 1
                        hit[k + n] -= 1
                        found.setdefault(int(text[k]), set()).add(at)
            for t, ats in found.items():
                numbers = np.unique(np.concatenate([known.item[known.items[at] : known.items[at + 1]] for at in ats]))
                items.setdefault(t, set()).update(self.names[i] for i in numbers.tolist() if i < len(self.names))
        covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        if len(covered):
            breaks = np.flatnonzero((np.diff(covered) > 1) | (np.diff(text[covered]) > 0)) + 1
            for run in np.split(covered, breaks):
                t = int(text[run[0]])
                spans.setdefault(t, []).append((int(run[0]), int(run[-1]) + 1, int(starts[run[0]] - offsets[t]), int(ends[run[-1]] - offsets[t])))
        return n_words, spans, items


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs with n_words, hits (array of word and byte spans: first, end, start_byte, end_byte) and items (sorted ids).

    The size of the benchmark's set is measured first. Up to group_bytes it is one broadcast set; beyond, its items are dealt
    to as many sets by a hash, and each is scanned after the other over the checkpointed result, so that neither
    driver nor executors ever hold more than one set.
    """
    spark = docs.sparkSession
    docs = without(docs, _NEW)
    named = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = F.octet_length("t") + F.lit(WORD_BYTES) * F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = named.agg(F.sum(size)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    for g in range(groups):
        part = named if groups == 1 else named.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast(BenchmarkSet(part.toArrow(), width))
        if g:
            docs = cut(docs)
        docs = _scan_one(docs, shared, text, first=g == 0)
    return docs


def _scan_one(docs: DataFrame, shared, text: str, first: bool) -> DataFrame:
    span = T.StructType([T.StructField(x, T.LongType()) for x in ("first", "end", "start_byte", "end_byte")])
    plain = docs.drop("n_words", "hits", "items") if not first else docs
    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    span_type = pa.struct([(x, pa.int64()) for x in span.fieldNames()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, data, offsets in chunks(column_of(batch, text)):
                n_words, spans, items = known.scan(data, offsets)
                rows = batch.slice(a, b - a)
                hits = [[dict(zip(span.fieldNames(), s)) for s in spans.get(k, [])] for k in range(b - a)]
                ids = [sorted(items.get(k, [])) for k in range(b - a)]
                if not first:
                    hits = [_merged(x or [], y) for x, y in zip(column_of(rows, "hits").to_pylist(), hits)]
                    ids = [sorted({*(x or []), *y}) for x, y in zip(column_of(rows, "items").to_pylist(), ids)]
                kept = [rows.column(k) for k, f in enumerate(rows.schema) if first or f.name not in ("n_words", "hits", "items")]
                names = [f.name for f in rows.schema if first or f.name not in ("n_words", "hits", "items")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(span_type)), pa.array(ids, pa.list_(pa.string()))], [*names, "n_words", "hits", "items"])

    return docs.mapInArrow(run, schema)


def _merged(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: (s["first"], s["end"])):
        if out and s["first"] <= out[-1]["end"]:
            if s["end"] > out[-1]["end"]:
                out[-1] = out[-1] | {"end": s["end"], "end_byte": s["end_byte"]}
        else:
            out.append(s)
    return out


def n_hit(hits: str = "hits") -> Column:
    return F.expr(f"aggregate({hits}, 0L, (n, s) -> n + s.end - s.first)")


def contaminated(words_: Column, hit: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (hit > 0) & (F.lit(20) * hit >= words_)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones; the others are left as they are."""
    docs, restore = aside(docs, _NEW)
    scanned = scan(docs, benchmark, text)
    return restore(scanned.where(~contaminated(F.col("n_words"), n_hit())).drop(*_NEW))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs whose benchmark passages are cut out of the text, whole windows at a time."""
    docs, restore = aside(docs, _NEW)
    scanned = scan(docs, benchmark, text)
    (raw,) = fresh(scanned, "raw")
    # The gaps between the spans, taken from the text's bytes.
    gaps = f"transform(sequence(0, size(hits)), k -> struct(if(k = 0, 0L, hits[greatest(k - 1, 0)].end_byte) AS a, if(k = size(hits), cast(octet_length({raw}) AS bigint), hits[least(k, size(hits) - 1)].start_byte) AS b))"
    piece = f"concat_ws('', transform({gaps}, g -> decode(substring({raw}, int(g.a) + 1, int(g.b - g.a)), 'UTF-8')))"
    out = scanned.withColumn(raw, F.col(text).cast("binary")).withColumn(text, F.when(F.size("hits") > 0, F.expr(piece)).otherwise(F.col(text)))
    return restore(out.drop(raw, *_NEW))
