"""The vector index against brute force: planted neighbours, work a query, stored form, odd rows."""

from __future__ import annotations

import glob

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vector_index as vi
from corpusloom.plans import catalogue

SCHEMA = "vec_id long, embedding array<double>"


def planted(n, dim, near, seed=0):
    """n random unit vectors; for the first `near` a neighbour of a cosine of 0.92 to 0.98."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(near, dim))
    y -= (y * x[:near]).sum(axis=1, keepdims=True) * x[:near]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = rng.uniform(0.92, 0.98, (near, 1))
    return np.vstack([x, cosine * x[:near] + np.sqrt(1 - cosine**2) * y])


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA).repartition(6)


def brute(x, queries, k):
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), score.shape), -score), axis=1)[:, :k]
    return order, np.take_along_axis(score, order, axis=1)


@pytest.fixture(scope="module")
def built(spark):
    x = planted(9000, 32, 400)
    rows = table(spark, x)
    model = vi.fit(rows, per_cell=64)
    return x, rows, model, vi.index(rows, model).persist()


def test_recall_of_planted_neighbours(spark, built):
    x, rows, model, indexed = built
    queries = list(range(0, 400))
    got = {r["query_id"]: r for r in vi.search(rows.where("vec_id < 400"), indexed, model, 0.9).collect()}
    want, score = brute(x, queries, 1)
    right = sum(q in got and got[q]["vec_id"] == want[i, 0] and abs(got[q]["score"] - score[i, 0]) < 1e-9 for i, q in enumerate(queries))
    assert right / len(queries) >= 0.95
    assert all(r["score"] >= 0.9 for r in got.values())


def test_every_vector_is_indexed_and_work_does_not_grow(spark, built):
    x, rows, model, indexed = built
    assert indexed.count() == len(x)
    looked = []
    for n in (2000, 8000):
        own = table(spark, planted(n, 16, 0, seed=n))
        m = vi.fit(own, per_cell=64, rounds=3)
        sizes = vi.index(own, m).groupBy("cell").agg(F.count("*").alias("n"))
        looked.append(vi.probes(own.where("vec_id < 200"), m).join(sizes, "cell").agg(F.sum("n")).first()[0] / 200)
    assert looked[1] < 1.3 * looked[0]


def test_all_cells_are_exhaustive(spark):
    """With every cell looked at and all re-ranked the search is exact, k results, in pieces of a few rows."""
    x = planted(300, 8, 50, seed=3)
    rows = table(spark, x)
    model = vi.fit(rows, per_cell=40, rounds=2)
    got = {}
    for r in vi.search(rows.where("vec_id % 20 = 0"), vi.index(rows, model), model, 0.2, k=3, n_probes=1000, rerank=400, block=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    queries = list(range(0, 350, 20))
    order, score = brute(x, queries, 3)
    want = {q: [(k + 1, int(order[i, k]), round(float(score[i, k]), 9)) for k in range(3) if score[i, k] >= 0.2] for i, q in enumerate(queries)}
    assert {q: sorted(r) for q, r in got.items()} == {q: r for q, r in want.items() if r}


def test_stored_index_reads_the_cells_asked_for(spark, built, tmp_path):
    x, rows, model, indexed = built
    path = str(tmp_path / "index")
    vi.save(indexed, model, path)
    some = rows.where("vec_id < 3")
    assert sorted(map(tuple, vi.search_stored(some, path, 0.9).collect())) == sorted(map(tuple, vi.search(some, indexed, model, 0.9).collect()))
    # All but the folders of the queries' cells are made unreadable: the answers stay.
    want = sorted(map(tuple, vi.search_stored(some, path, 0.9).collect()))
    touched = {r["b"] for r in vi.probes(some, model).select(F.expr(f"cell % {vi.BUCKETS}").alias("b")).collect()}
    spoilt = [f for f in glob.glob(f"{path}/rows/bucket=*/*.parquet") if int(f.split("bucket=")[1].split("/")[0]) not in touched]
    assert len(spoilt) > 50
    for f in spoilt:
        with open(f, "wb") as out:
            out.write(b"not a table")
    assert sorted(map(tuple, vi.search_stored(some, path, 0.9).collect())) == want
    new = spark.createDataFrame([(100_000, x[1].tolist())], SCHEMA)
    vi.add(new, path)
    assert vi.search_stored(rows.where("vec_id = 1"), path, 0.99).first()["vec_id"] == 100_000


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 1e-9]), (10, [float("inf"), 0.0])]
    given = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "'x' AS id")
    model = vi.fit(given)
    indexed = vi.index(given, model)
    assert sorted(r["id"] for r in indexed.collect()) == [1, 2, 2, 9]
    got = {r["query_id"]: (r["vec_id"], round(r["score"], 6)) for r in vi.search(given, indexed, model, 0.5).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 9: (1, 1.0)}
    empty = given.limit(0)
    assert vi.fit(empty) is None and vi.search(given, indexed, None).collect() == [] and vi.search(empty, indexed, model).collect() == []


def test_exact_misses_none(spark, built):
    """Where the search looks at one cell and one code a query it misses most; the exact one does not, in bundles and pieces of any size."""
    x, rows, model, indexed = built
    queries = list(range(0, 9400, 47))
    order, score = brute(x, queries, 3)
    asked = rows.where("vec_id % 47 = 0")
    for threshold, bundle, least in ((0.3, 1000, 100), (0.9, 50, 1), (-1.0, 65536, 1024)):
        want = {(q, int(order[i, k]), k + 1) for i, q in enumerate(queries) for k in range(3) if score[i, k] >= threshold}
        got = {(r["query_id"], r["vec_id"], r["rank"]) for r in vi.exact(asked, indexed, model, threshold, k=3, n_probes=1, rerank=1, bundle=bundle, least=least).collect()}
        assert got == want
    found = {(r["query_id"], r["vec_id"]) for r in vi.search(asked, indexed, model, 0.3, n_probes=1, rerank=1).collect()}
    assert len({(q, int(order[i, 0])) for i, q in enumerate(queries) if score[i, 0] >= 0.3} - found) > 20


def test_exact_odd_rows(spark):
    """Many copies and multiples of one vector, repeated ids and pairs of flipped signs: the smallest other id of the best."""
    rows = [(k, [0.3, 0.7, -0.2]) for k in range(200, 40, -1)] + [(7, [0.1, 0.9, 0.4]), (7, [0.1, 0.9, 0.4]), (8, [-0.1, -0.9, 0.4]), (300, [0.6, 1.4, -0.4]), (301, [-0.3, -0.7, -0.2]), (41, [0.3, 0.7, -0.2]), (400, [0.0, 0.0, 0.0]), (401, None), (None, [1.0, 0.0, 0.0])]
    given = spark.createDataFrame(rows, SCHEMA)
    model = vi.fit(given)
    indexed = vi.index(given, model)
    got = {}
    for r in vi.exact(given, indexed, model, 0.95, k=2, bundle=50, least=1).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = {k: {1: 41, 2: 42} for k in [*range(43, 201), 300]} | {41: {1: 42, 2: 43}, 42: {1: 41, 2: 43}}
    assert got == want
    empty = given.limit(0)
    assert vi.exact(empty, indexed, model).collect() == [] and vi.exact(given, vi.index(empty, model), model).collect() == []
    assert vi.exact(given, vi.index(given, None), None).collect() == []


def test_query_equals_its_sql(spark, tmp_path):
    """Tight clusters, whose vectors' codes say little, and copies beyond the number that is compared exactly."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(4, 64)), 300, axis=0) + 0.3 * rng.normal(size=(1200, 64))
    x[1000:1150] = x[1000]
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(catalogue.ORACLE_SQL["semantic_index"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()
    assert len(want) == 120 and sorted(want) == sorted(map(tuple, catalogue.QUERIES["semantic_index"](spark, str(tmp_path)).collect()))
