"""Large tables in folders by a hash of the key: upserts that write and read the buckets of their keys only, and a set of seen keys with Bloom filters before it.

Both hold batches in order of their numbers. A batch that is written again after a failure replaces its own folders, so the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut
from . import store

BUCKETS = 256


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Into folders by the columns by; folders that exist are replaced, others stay."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class MergeTable:
    """A table of one row a key, kept as what batches wrote (merge on read).

    Folders are bucket=B/lo=M/hi=N, the merged writes of batches M to N to the keys of bucket B; a batch writes those with lo = hi, of its own keys' buckets. A reader merges a
    key's rows as `store.upsert` does: the updated columns take the last batch's value, the others the first's. compact() merges a bucket's folders into one that covers
    them; a folder inside the span of another of its bucket is dead, and vacuum() removes it.

    Rows with a null key are left out. Within a batch rows of a key apply in the order of seq; equal ones in any order. An empty batch writes nothing; extra columns are
    not stored, missing ones are null.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url", seq: str = "seq", updated: Iterable[str] = store.UPDATED, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.seq, self.updated, self.buckets = spark, f"{path}/rows", key, seq, tuple(updated), buckets
        self.schema = T._parse_datatype_string(schema)
        self.columns = self.schema.fieldNames()

    def bucket(self) -> F.Column:
        return F.expr(f"int(pmod(xxhash64({self.key}), {self.buckets}))")

    def write(self, batch: DataFrame, number: int) -> None:
        """Adds the batch of this number."""
        given = {c.lower() for c in batch.columns}
        rows = batch.select(*((F.col(f.name) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.col(self.seq).alias("_seq"))
        merged = store.upsert(None, rows, self.key, "_seq", self.updated).select(*self.columns)
        _write(merged.select("*", self.bucket().alias("bucket"), F.lit(number).alias("lo"), F.lit(number).alias("hi")), self.path, "bucket", "lo", "hi")

    def _all(self) -> DataFrame:
        whole = T.StructType([*self.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("bucket", "lo", "hi"))])
        return self.spark.read.schema(whole).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], whole)

    def spans(self, buckets: list[int] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(live, dead) folders as (bucket, lo, hi). Only names of folders are looked at, not rows' columns."""
        rows = self._all().select("bucket", "lo", "hi")
        found = [tuple(r) for r in (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).distinct().collect()]
        covers = lambda a, b: a != b and a[0] == b[0] and a[1] <= b[1] and b[2] <= a[2]
        by: dict[int, list] = {}
        for s in found:
            by.setdefault(s[0], []).append(s)
        dead = {s for own in by.values() for s in own if any(covers(o, s) for o in own)}
        return sorted(s for s in found if s not in dead), sorted(dead)

    def _live(self, buckets: list[int] | None = None) -> DataFrame:
        live, _ = self.spans(buckets)
        held = self.spark.createDataFrame(live, "bucket int, lo int, hi int")  # folders: a few a bucket
        rows = self._all() if buckets is None else self._all().where(F.col("bucket").isin(buckets))
        return rows.join(F.broadcast(held), ["bucket", "lo", "hi"])

    def _merged(self, rows: DataFrame, *more: str) -> DataFrame:
        picks = [F.max_by(F.struct(c), "hi")[c].alias(c) if c in self.updated else F.min_by(F.struct(c), "lo")[c].alias(c) for c in self.columns if c != self.key]
        return rows.groupBy(*more, self.key).agg(*picks).select(*self.columns, *more)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The table, or its rows of the keys in a column of the key's name: then only those keys' buckets are read."""
        if keys is None:
            return self._merged(self._live())
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        touched = [r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()]
        return self._merged(self._live(touched).join(wanted, self.key, "left_semi"))

    def compact(self, least: int = 4) -> list[int]:
        """Merges the folders of buckets that have `least` or more; the buckets."""
        by: dict[int, list] = {}
        for s in self.spans()[0]:
            by.setdefault(s[0], []).append(s)
        some = {b: (min(s[1] for s in own), max(s[2] for s in own)) for b, own in by.items() if len(own) >= least}
        if some:
            to = self.spark.createDataFrame([(b, lo, hi) for b, (lo, hi) in some.items()], "bucket int, _lo int, _hi int")
            merged = self._merged(self._live(list(some)), "bucket").join(F.broadcast(to), "bucket")
            _write(merged.withColumnsRenamed({"_lo": "lo", "_hi": "hi"}), self.path, "bucket", "lo", "hi")
        return sorted(some)

    def vacuum(self) -> int:
        """Removes dead folders; their number."""
        dead = self.spans()[1]
        for b, lo, hi in dead:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}/lo={lo}/hi={hi}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(dead)


# Bloom filters: a bucket's state is a list of layers (capacity, keys, hashes, bits).


def layer_shape(capacity: int, error: float) -> tuple[int, int]:
    """(bits, hashes) of a layer."""
    return max(64, 8 * math.ceil(-capacity * math.log(error) / math.log(2) ** 2 / 8)), max(1, round(-math.log2(error)))


def _places(a: np.ndarray, b: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a.astype(np.int64).view(np.uint64)[:, None] + np.arange(hashes, dtype=np.uint64) * (b.astype(np.int64).view(np.uint64) | np.uint64(1))[:, None]
    return (h % np.uint64(bits)).astype(np.int64)


class Bloom:
    """A scalable filter: each layer has twice the capacity of the one before and half its error, so the errors of all add up to `error` at most."""

    def __init__(self, capacity: int, error: float, layers: list[tuple[int, int, int, bytes]] = ()) -> None:
        self.capacity, self.error = capacity, error
        self.layers = [[c, n, k, np.frombuffer(raw, dtype=np.uint8).copy()] for c, n, k, raw in layers]

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for _, _, hashes, bits in self.layers:
            at = _places(a, b, 8 * len(bits), hashes)
            out |= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            if not self.layers or self.layers[-1][1] >= self.layers[-1][0]:
                n = len(self.layers)
                bits, hashes = layer_shape(self.capacity << n, self.error / 2 ** (n + 1))
                self.layers.append([self.capacity << n, 0, hashes, np.zeros(bits // 8, dtype=np.uint8)])
            last = self.layers[-1]
            room = last[0] - last[1]
            at = _places(a[:room], b[:room], 8 * len(last[3]), last[2]).ravel()
            np.bitwise_or.at(last[3], at >> 3, (1 << (at & 7)).astype(np.uint8))
            last[1] += len(a[:room])
            a, b = a[room:], b[room:]

    def state(self) -> list[tuple[int, int, int, bytes]]:
        return [(c, n, k, bits.tobytes()) for c, n, k, bits in self.layers]


def _bloom(held: pa.Table, capacity: int, error: float) -> Bloom:
    rows = sorted(zip(*(held.column(c).to_pylist() for c in ("layer", "capacity", "n", "hashes", "bits"))))
    return Bloom(capacity, error, [r[1:] for r in rows])


class SeenTable:
    """A persistent set of keys: keys by bucket, and for each bucket a Bloom filter of them.

    A key that its bucket's filter doesn't know is new without a look at any key; only the buckets of the others are read, and answers are exact. A batch of keys reads
    the filters of its own buckets, and writes those and its new keys. A bucket's keys of one batch, and its filter, are one task's.

    Null keys are never seen and not kept; a key that a batch repeats is one. capacity is that of a bucket's first layer.
    """

    KEYS, FILTERS = "key string, bucket int, batch int", "layer int, capacity long, n long, hashes int, bits binary, bucket int, batch int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, capacity: int = 4096, error: float = 0.0001) -> None:
        self.spark, self.path, self.buckets, self.capacity, self.error = spark, path, buckets, capacity, error

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if _exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _asked(self, keys: DataFrame, key: str) -> DataFrame:
        rows = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
        return rows.select("key", F.expr(f"int(pmod(xxhash64(key), {self.buckets}))").alias("bucket"), F.xxhash64("key", F.lit(1)).alias("a"), F.xxhash64("key", F.lit(2)).alias("b"))

    def _filters(self, touched: list[int], before: int) -> DataFrame:
        rows = self._table("filters", self.FILTERS).where(F.col("bucket").isin(touched) & (F.col("batch") < before))
        last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), ["bucket", "batch"])

    def maybe(self, asked: DataFrame, filters: DataFrame) -> DataFrame:
        """(key, bucket) of the asked keys that the filters know."""
        capacity, error = self.capacity, self.error

        def test(own: pa.Table, held: pa.Table) -> pa.Table:
            a, b = (own.column(c).to_numpy() for c in ("a", "b"))
            return own.filter(pa.array(_bloom(held, capacity, error).has(a, b))).select(["key", "bucket"])

        return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "key string, bucket int")

    def _known(self, asked: DataFrame, filters: DataFrame, before: int) -> DataFrame:
        """The asked keys that were added by batches before."""
        maybe = cut(self.maybe(asked, filters))
        touched = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        held = self._table("keys", self.KEYS).where(F.col("bucket").isin(touched) & (F.col("batch") < before))
        return maybe.join(held.select("key"), "key", "left_semi").select("key")

    def probe(self, keys: DataFrame, key: str = "url", before: int = 1 << 30) -> DataFrame:
        """(key, seen) of each key that isn't null."""
        asked = cut(self._asked(keys, key))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        known = self._known(asked, self._filters(touched, before), before).withColumn("seen", F.lit(True))
        return asked.select("key").join(known, "key", "left").select("key", F.coalesce("seen", F.lit(False)).alias("seen"))

    def add(self, keys: DataFrame, number: int, key: str = "url") -> DataFrame:
        """Adds the batch of this number; the keys (key) that no batch before it had."""
        asked = cut(self._asked(keys, key))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        filters = cut(self._filters(touched, number))
        new = cut(asked.join(self._known(asked, filters, number), "key", "left_anti"))
        _write(new.select("key", "bucket", F.lit(number).alias("batch")), f"{self.path}/keys", "bucket", "batch")
        capacity, error = self.capacity, self.error

        def grown(own: pa.Table, held: pa.Table) -> pa.Table:
            known = _bloom(held, capacity, error)
            if own.num_rows:
                known.add(*(own.column(c).to_numpy() for c in ("a", "b")))
            state = known.state() if own.num_rows else []
            columns = [[n, *layer, own.column("bucket")[0].as_py()] for n, layer in enumerate(state)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            return pa.Table.from_arrays([pa.array([row[k] for row in columns], kind) for k, kind in enumerate(kinds)], ["layer", "capacity", "n", "hashes", "bits", "bucket"])

        state = new.groupBy("bucket").cogroup(filters.drop("batch").groupBy("bucket")).applyInArrow(grown, "layer int, capacity long, n long, hashes int, bits binary, bucket int")
        _write(state.withColumn("batch", F.lit(number)), f"{self.path}/filters", "bucket", "batch")
        return new.select("key")
