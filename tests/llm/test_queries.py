"""The registered queries of the subpackage on a small table: against their SQL, or else against plain versions of what their contract fixes."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from test_operators import fingerprint, groups_of

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def test_every_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", q)[1]) for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_sharding", "op3_decontamination", "op4_mixing", "op7_embeddings", "op9_html", "op10_language_model", "op13_vector_codes"])
def test_against_sql(spark, con, name):
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))


def test_secrets(spark, texts):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
    )
    rows = entry.queries()["op1_secrets"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(kinds) for m in p.finditer(texts[r["doc_id"]] or "") if len(m[group]) >= least]
        base = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert not collections.Counter(base) - collections.Counter(r["spans"].split(","))


@pytest.mark.parametrize(("name", "modulus", "rest", "limit"), [("op5_quality", 5, 0, 0.3), ("op6_toxicity", 3, 1, 0.7)])
def test_scores(spark, texts, name, modulus, rest, limit):
    rows = entry.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)


def test_simhash(spark, texts):
    ids = sorted(texts)
    fps = [fingerprint(texts[k]) for k in ids]
    want = {k: (f"{f:016x}", ids[g]) for k, f, g in zip(ids, fps, groups_of(fps))}
    rows = entry.queries()["op8_simhash"](spark, SF).collect()
    assert len(rows) == len(ids) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want
