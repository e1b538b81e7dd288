"""Metric queries over event rows: rates, gauges, histograms and their quantiles, spans of traces.

A rate is the count in a window over its seconds. Quantiles interpolate linearly in cumulative buckets, as monitoring
systems do, and are not exact percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the buckets in milliseconds.
FETCH_MS = (50, 100, 250, 500, 1000, 2500, 5000, 10000)
PARSE_MS = (1, 5, 10, 25, 50, 100, 250, 500)
ENRICH_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500)
#: Windows in a stretch of a label's time.
STRETCH = 16


def rate(events: DataFrame, ts: str, label: str, seconds: int = 60) -> DataFrame:
    """(window_start, label, rate) in tumbling windows."""
    out = events.groupBy(F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w"), F.col(label).alias("label")).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "label", "rate")


def trailing_rate(events: DataFrame, ts: str, label: str, seconds: int = 60) -> DataFrame:
    """events with rate: occurrences of the label in the seconds up to and including the row's; null for a row without a time.

    A label's time is cut in stretches of STRETCH windows, each a task's work; of the stretch before, it gets the times (no other column) of the last window.
    So a label with a third of all rows is shared by many tasks, and a row in STRETCH comes twice.
    """
    span = seconds * 1_000_000
    width = span * STRETCH
    kept = [c for c in events.columns if c.lower() != "rate"]
    rows = events.select(F.struct(*kept).alias("row"), F.col(label).alias("lane"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    own = F.floor(F.col("us") / F.lit(width)).cast("long")
    late = F.col("us") >= (own + 1) * width - span + 1
    idle = F.array(F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    rows = rows.select("row", "lane", "us", F.posexplode(F.when(F.col("us").isNull(), idle).when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("copy", "stretch"))
    rows = rows.withColumn("row", F.when(F.col("copy") == 0, F.col("row")))
    window = Window.partitionBy("lane", "stretch").orderBy("us").rangeBetween(-span + 1, 0)
    counted = rows.withColumn("n", F.count("*").over(window)).where("copy = 0")
    return counted.select("row.*", F.when(F.col("us").isNotNull(), F.col("n") / F.lit(float(seconds))).alias("rate"))


def totals(events: DataFrame, label: str, unknown: str = "unknown") -> DataFrame:
    """(label, n) with empty and null labels as unknown."""
    return events.groupBy(F.coalesce(F.nullif(F.col(label).cast("string"), F.lit("")), F.lit(unknown)).alias("label")).agg(F.count("*").alias("n"))


def gauge(samples: DataFrame, ts: str, value: str, label: str) -> DataFrame:
    """(label, value): the last sample of each, ties by the larger value."""
    return samples.groupBy(F.col(label).alias("label")).agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(value))).alias("value"))


def histogram(events: DataFrame, value: str, bounds: tuple = FETCH_MS, by: list[Column] | None = None) -> DataFrame:
    """(*by, le, cumulative) of the non-null values, with le = infinity last. One aggregation: buckets are columns, then rows."""
    every = [*map(float, bounds), float("inf")]
    sums = [F.sum((F.col(value) <= F.lit(b)).cast("long")).alias(f"_b{k}") for k, b in enumerate(every)]
    wide = events.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(*sums)
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.coalesce(F.col(f"_b{k}"), F.lit(0)).alias("cumulative")) for k, b in enumerate(every)))
    kept = [c for c in wide.columns if not c.startswith("_b")]
    return wide.select(*kept, F.inline(pairs))


def quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """(*by, q, value) by linear interpolation in the bucket that holds the rank; the highest finite bound beyond; null without values."""
    lane = Window.partitionBy(*(by or [F.lit(1)])).orderBy("le")
    total = F.max("cumulative").over(Window.partitionBy(*(by or [F.lit(1)])))
    stepped = buckets.withColumns({"_low": F.coalesce(F.lag("le").over(lane), F.lit(0.0)), "_before": F.coalesce(F.lag("cumulative").over(lane), F.lit(0)), "_total": total})
    rank = F.lit(q) * F.col("_total")
    hit = stepped.where((F.col("cumulative") >= rank) & (F.col("_total") > 0)).withColumn("_r", rank)
    first = hit.groupBy(*(by or [])).agg(F.min_by(F.struct("le", "cumulative", "_low", "_before", "_r"), "le").alias("b"))
    share = (F.col("b._r") - F.col("b._before")) / F.nullif(F.col("b.cumulative") - F.col("b._before"), F.lit(0))
    value = F.when(F.col("b.le") == float("inf"), F.col("b._low")).otherwise(F.col("b._low") + (F.col("b.le") - F.col("b._low")) * F.coalesce(share, F.lit(1.0)))
    return first.select(*(by or []), F.lit(q).alias("q"), value.alias("value"))


def spans(traces: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """(stage, n, total_ms, mean_ms, max_ms) of trace spans."""
    return traces.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))


#: The named metrics: what each is, and the buckets and quantiles of the latencies.
CATALOGUE: dict[str, tuple] = {
    "pages_per_second": ("rate", 60), "error_rate": ("rate", 60), "total_pages": ("total",), "frontier_size": ("gauge",), "active_browsers": ("gauge",), "queue_depth": ("gauge",),
    "healthy_proxies": ("gauge",), "fetch_latency": ("latency", FETCH_MS, (0.5, 0.95, 0.99)), "parse_latency": ("latency", PARSE_MS, (0.5, 0.95)), "enrich_latency": ("latency", ENRICH_MS, (0.95,)),
    "duplicates_by_kind": ("totals",), "pages_by_language": ("totals",), "pages_by_renderer": ("totals",), "breaker_trips": ("totals",),
}


def named(name: str, events: DataFrame, ts: str = "ts", value: str = "value", label: str = "label", metric: str | None = None) -> DataFrame:
    """A metric of the catalogue over event rows: (window_start, label, rate), (n), (label, value), (label, q, value) or (label, n).

    With metric, a column of names, events hold several metrics and only those of this one count.
    """
    kind, *how = CATALOGUE[name]
    if metric:
        events = events.where(F.col(metric) == name)
    if kind == "rate":
        return rate(events, ts, label, *how)
    if kind == "total":
        return events.agg(F.count("*").alias("n"))
    if kind == "gauge":
        return gauge(events, ts, value, label)
    if kind == "totals":
        return totals(events, label)
    bounds, quantiles = how
    buckets = histogram(events, value, bounds, [F.col(label).alias("label")])
    out = [quantile(buckets, q, ["label"]) for q in quantiles]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
