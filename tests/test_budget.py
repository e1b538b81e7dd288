"""Running budgets: restarts in mid-stream, budgets in every micro-batch, hot domains, periods, odd rows."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from corpusloom.streaming import budget

ROWS = "domain string, id long, ts timestamp"
START = datetime(2024, 1, 1)


def plain(batches, budget_of, period=None):
    used, out = defaultdict(int), []
    for rows in batches:
        for d, i, t in sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1])):
            d = d or ""
            key = (d, (t - START) // timedelta(seconds=period) if period else 0)
            used[key] += 1
            out.append((d, i, used[key] if used[key] <= budget_of(d) else None, used[key] <= budget_of(d)))
    return sorted(out, key=repr)


def replayed(spark, tmp_path, batches, **how):
    """Each batch is a stream of its own run over one checkpoint: a restart between all of them."""
    seen = []
    with budget.state_store(spark):
        for rows in batches:
            spark.createDataFrame(rows, ROWS).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
            stream = budget.grants(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), **how)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
            seen.append(spark.read.parquet(f"{tmp_path}/out").collect())
    return seen


def drawn(seed, n, sizes):
    rng = random.Random(seed)
    return [[(rng.choice(["hot"] * 5 + ["a", "b", None]), 1000 * k + rng.randrange(40), START + timedelta(seconds=rng.randrange(n))) for _ in range(s)] for k, s in enumerate(sizes)]


def test_restarts_give_the_batch_result(spark, tmp_path):
    batches = drawn(1, 5, (60, 3, 80))
    batches[0] += [("a", 7, None), ("a", 7, None)]
    wanted = {"hot": 25, "a": 4, "": 3}
    seen = replayed(spark, tmp_path, batches, default=3, overrides={"hot": 25, "a": 4})
    got = sorted(((r["domain"], r["id"], r["place"], r["allowed"]) for r in seen[-1]), key=repr)
    assert got == plain(batches, lambda d: wanted.get(d, 3))
    for rows in seen:  # after each micro-batch
        for d in {r["domain"] for r in rows}:
            places = sorted(r["place"] for r in rows if r["domain"] == d and r["allowed"])
            assert places == list(range(1, len(places) + 1)) and len(places) <= wanted.get(d, 3)


def test_periods_end_by_timers(spark, tmp_path):
    batches = [[("a", k, START + timedelta(seconds=s)) for k, s in rows] for rows in ([(1, 0), (2, 1), (3, 2)], [(4, 100), (5, 159)], [(6, 400), (7, 401), (8, 402)])]
    seen = replayed(spark, tmp_path, batches, default=2, period=60, late="1 second")
    assert sorted(((r["domain"], r["id"], r["place"], r["allowed"]) for r in seen[-1]), key=repr) == plain(batches, lambda d: 2, 60)
    kept = spark.read.format("statestore").option("stateVarName", "used").load(f"{tmp_path}/state").selectExpr("key.domain", "user_map_key.period").collect()
    assert [r["period"] for r in kept] == [int((START + timedelta(seconds=360) - datetime(1970, 1, 1)).total_seconds() * 1000)]


def test_idle_domains_start_anew(spark, tmp_path):
    batches = [[("a", 10 * b + k, START) for k in range(3)] for b in range(2)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for name, idle, places in (("long", 3600, [1, 2]), ("short", 1, [1, 1, 2, 2])):
            seen = replayed(spark, tmp_path / name, batches, default=2, idle_seconds=idle)  # a run takes longer than a second to start
            assert sorted(r["place"] for r in seen[-1] if r["allowed"]) == places and len(seen[-1]) == 6
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_idle_and_period_exclude_each_other(spark):
    with pytest.raises(ValueError):
        budget.grants(spark.createDataFrame([], ROWS), period=60, idle_seconds=5)
