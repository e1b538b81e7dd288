"""Components, cells and runs against plain versions."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells


def plain(pairs):
    low = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@pytest.mark.parametrize("contract", [1 << 20, 3])
def test_components(spark, monkeypatch, contract):
    monkeypatch.setattr(cells, "CONTRACT", contract)
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(60)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 80, (50, 2))] + [(-5, -3), (-5, -9), (7, 7), (2**62, -(2**62))]
    frame = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in cells.components(frame).collect()}
    loose = {a for a, b in pairs if a == b and sum(a in p for p in pairs) == 1}
    assert got == {k: v for k, v in plain(pairs).items() if k not in loose and sum(w == v for w in plain(pairs).values()) > 1}
    assert cells.components(frame.limit(0)).count() == 0


def test_cells_meet_every_pair(spark):
    frame = spark.createDataFrame([(k % 3, m) for k in range(3) for m in range((5, 40, 1)[k])], "key long, m long")
    for alone in (False, True):
        dealt = cells.cells(frame, "key", "m", 8, alone).collect()
        met = collections.Counter()
        by = collections.defaultdict(list)
        for r in dealt:
            by[r["key"], r["i"], r["j"]].append(r)
        for (key, i, j), rows in by.items():
            met.update((key, min(a["m"], b["m"]), max(a["m"], b["m"])) for a in rows for b in rows if a["m"] < b["m"] and {a["piece"], b["piece"]} == {i, j})
        assert met == {(k, a, b): 1 for k, n in ((0, 5), (1, 40)) for a in range(n) for b in range(a + 1, n)}
        assert (2 in {r["key"] for r in dealt}) == alone


def test_whole_runs():
    values = np.sort(np.random.default_rng(2).integers(0, 9, 100))
    batches = [pa.RecordBatch.from_arrays([pa.array(values[k : k + 7])], ["k"]) for k in range(0, 100, 7)]
    tables = list(cells.whole_runs(iter(batches), ["k"], 10))
    assert np.concatenate([t.column("k").to_numpy() for t in tables]).tolist() == values.tolist()
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(tables, tables[1:]))
    begin, end = cells.runs([values])
    assert [values[a] for a in begin] == sorted(set(values.tolist())) and end[-1] == 100


def test_checkpoint_folder(spark, tmp_path):
    from corpusloom.functions import session

    assert session.checkpoint_folder(spark) == spark.sparkContext.getCheckpointDir()
    assert session.cut(spark.range(3).select(F.col("id"))).count() == 3
