"""Tables by buckets: merge on read against store.upsert, files touched, compaction; Bloom filters and the set of seen keys."""

from __future__ import annotations

import glob
import os
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.sources import buckets, store

ROWS = "url string, title string, etag string, seq long"


def batches(seed=1, n=4):
    rng = random.Random(seed)
    return [[(rng.choice([None, *(f"u{k}" for k in range(30))]), rng.choice([None, "a", "b", f"t{b}"]), rng.choice([None, f"e{b}"]), s) for s in range(40)] for b in range(n)]


def rows_of(df):
    return sorted(map(repr, df.select("url", "title", "etag").collect()))


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_merge_on_read_against_upsert(spark, tmp_path):
    table = buckets.MergeTable(spark, str(tmp_path), "url string, title string, etag string", buckets=8)
    assert table.read().collect() == [] and table.compact() == []
    want = None
    for number, own in enumerate(batches()):
        batch = spark.createDataFrame(own, ROWS).withColumn("hi", F.lit("extra")).repartition(3)
        table.write(batch, number)
        table.write(batch, number)  # once more, after a failure
        want = store.upsert(want, batch.drop("hi"))
        want = spark.createDataFrame(want.withColumn("seq", F.lit(0)).collect(), "url string, title string, etag string, seq long")
        assert rows_of(table.read()) == rows_of(want)
        if number == 2:
            assert table.compact(2) and rows_of(table.read()) == rows_of(want)
            live, dead = table.spans()
            assert dead and all((lo, hi) == (0, 2) for _, lo, hi in live if [s[0] for s in live].count(_) == 1 and hi == 2)
            assert table.vacuum() == len(dead) and table.spans() == (live, []) and rows_of(table.read()) == rows_of(want)
    some = spark.createDataFrame([("u3",), ("u7",), (None,), ("nobody",)], "url string")
    assert rows_of(table.read(some)) == rows_of(want.where("url IN ('u3', 'u7')"))


def test_a_batch_writes_and_reads_its_own_buckets(spark, tmp_path):
    table = buckets.MergeTable(spark, str(tmp_path), "url string, title string, etag string", buckets=32)
    table.write(spark.createDataFrame([(f"u{k}", "x", "y", k) for k in range(500)], ROWS), 0)
    before = files(tmp_path)
    batch = spark.createDataFrame([("u1", "new", "z", 1), ("u2", "new", "z", 2)], ROWS)
    own = {r["b"] for r in batch.select(table.bucket().alias("b")).collect()}
    table.write(batch, 1)
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == own
    # Other buckets' files can't be read any more: the batch's keys still can.
    for f in before:
        if int(f.split("bucket=")[1].split("/")[0]) not in own:
            with open(f, "wb") as out:
                out.write(b"not a table")
    assert sorted(map(tuple, table.read(batch).collect())) == [("u1", "new", "y"), ("u2", "new", "y")]


def test_bloom_filters():
    """No false negative over several layers, and no more false positives than stated."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 40_000))
    f = buckets.Bloom(1000, 0.01)
    for at in range(0, 20_000, 3000):
        f.add(a[at : at + 3000], b[at : at + 3000])
    f = buckets.Bloom(1000, 0.01, f.state())
    assert len(f.layers) >= 4 and f.has(a[:21_000], b[:21_000]).all()
    assert f.has(a[21_000:], b[21_000:]).mean() <= 0.01
    assert not buckets.Bloom(1000, 0.01).has(a[:5], b[:5]).any()


def test_seen_table(spark, tmp_path):
    rng = random.Random(4)
    table = buckets.SeenTable(spark, str(tmp_path), buckets=8, capacity=16, error=0.05)
    seen: set = set()
    for number in range(4):
        own = [rng.choice([None, *(f"k{k}" for k in range(400))]) for _ in range(150)]
        batch = spark.createDataFrame([(u, "x") for u in own], "url string, bucket string").repartition(3)
        got = {r["key"]: r["seen"] for r in table.probe(batch).collect()}
        assert got == {u: u in seen for u in own if u is not None}
        new = {u for u in own if u is not None} - seen
        assert {r["key"] for r in table.add(batch, number).collect()} == new
        if number == 2:
            assert {r["key"] for r in table.add(batch, number).collect()} == new  # once more, after a failure
        seen |= new
    assert table.add(spark.createDataFrame([], "url string"), 9).collect() == []


def test_new_keys_read_no_keys(spark, tmp_path):
    table = buckets.SeenTable(spark, str(tmp_path), buckets=8)
    table.add(spark.createDataFrame([(f"k{k}",) for k in range(300)], "url string"), 0)
    for f in glob.glob(f"{tmp_path}/keys/**/*.parquet", recursive=True):
        with open(f, "wb") as out:
            out.write(b"not a table")
    assert not any(r["seen"] for r in table.probe(spark.createDataFrame([(f"new{k}",) for k in range(100)], "url string")).collect())
