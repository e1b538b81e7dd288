"""Bounded samples of labelled rows, for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import column_of

#: Characters of one window of an excerpt.
WINDOW = 400


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(labels: DataFrame, label: str, rows: int, train: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most `rows` ids of each class among labels that fulfil train.

    They are the first by a hash of the id, so a rerun takes the same ones. Null ids or labels are left out; an id
    with several labels counts with the largest.
    """
    known = labels.where(train).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return known.where("label = 1").orderBy(*order).limit(rows).unionByName(known.where("label = 0").orderBy(*order).limit(rows))


def texts_of(sample: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of the sample's documents. The sample is bounded by its limits, so it is the broadcast side."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.join(F.broadcast(sample), "doc_id")


def level(sizes: np.ndarray, total: int) -> int:
    """The largest size to which sizes can be cut so that they are total together at most; one at least."""
    ordered = np.sort(np.asarray(sizes, dtype=np.int64))
    if ordered.sum() <= total:
        return int(ordered[-1]) if len(ordered) else 1
    before = np.cumsum(ordered) - ordered
    cap = (total - before) // (len(ordered) - np.arange(len(ordered)))
    # Sizes up to the first that is above its share stay whole.
    return max(1, int(cap[np.flatnonzero(cap < ordered)[0]]))


def excerpt(text: str, most: int, window: int = WINDOW) -> str:
    """text, or, if it has more than most UTF-8 bytes, windows spread evenly over the whole of it, about as much together.

    Words that a window's edges cut are left out.
    """
    size = len(text.encode("utf-8", "surrogatepass"))
    if size <= most:
        return text
    chars = max(1, most * len(text) // size)
    n = max(1, round(chars / window))
    width = max(1, chars // n)
    parts = []
    for k in range(n):
        at = (len(text) - width) * (2 * k + 1) // (2 * n)
        part = text[at : at + width]
        inner = part if at == 0 else part.partition(" ")[2]
        parts.append((inner if at + width == len(text) else inner.rpartition(" ")[0]) or part)
    return " ".join(parts)


def excerpts(found: DataFrame, total: int) -> DataFrame:
    """(doc_id, label, text) with one row for each id of found(doc_id, label, text), texts cut to excerpts so that they are about
    total bytes together at most. found is a bounded sample of ids; rows that repeat an id are aggregated where they are."""
    sizes = found.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).select("n").toArrow().column("n").to_numpy()
    most = level(sizes, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                texts = pa.array([excerpt(t, most) for t in column_of(rows, "text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([column_of(rows, "doc_id"), column_of(rows, "label"), texts], ["doc_id", "label", "text"])

    schema = T.StructType([found.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("text", T.StringType())])
    cut_ = found.select("doc_id", "label", "text").mapInArrow(run, schema)
    return cut_.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
