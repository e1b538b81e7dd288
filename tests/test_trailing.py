"""Trailing rates in stretches against counting every window."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from corpusloom.operators import metrics


def test_trailing_rate_against_counting(spark):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(microseconds=rng.choice((rng.randrange(400_000_000), 1_000_000 * rng.randrange(400)))), rng.choice(["hot"] * 4 + ["a", None]), "x") for k in range(600)]
    rows += [(1000, None, "hot", "x"), (1001, None, None, "x"), (1002, start - timedelta(days=30000), "a", None), *rows[:3]]
    events = spark.createDataFrame(rows, "id long, at timestamp, label string, Rate string")
    got = metrics.trailing_rate(events, "at", "label", 3)
    assert got.columns == ["id", "at", "label", "rate"]

    def plain(at, label):
        if at is None:
            return None
        return sum(1 for _, t, own, _ in rows if t is not None and own == label and timedelta(0) <= at - t < timedelta(seconds=3)) / 3.0

    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, t, own, plain(t, own))) for k, t, own, _ in rows)
    assert metrics.trailing_rate(events.limit(0), "at", "label").collect() == []
