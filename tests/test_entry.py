"""The driver's entry points: names, columns and a few results against DuckDB."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_without_a_package_of_the_training_data_part():
    """The engine's queries are there even if only the other part can't be imported."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print('dedup_cascade' in q, any(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
    assert out.stdout.split() == ["True", "False", "False"], out.stderr


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["url_normalise", "simhash64", "frontier_fair", "dedup_cascade", "upsert_pg", "hist_quantile", "rate_schedule"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))
