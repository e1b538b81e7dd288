"""Per-domain state in batch form: rate schedule and circuit breaker. The streaming twins are in corpusloom.streaming."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELAY = 1.5
FAILURES, COOLDOWN = 5, 120.0


def schedule(requests: DataFrame, domain: str = "domain", arrival: str = "arrival", order: str = "event_id", delay: float = DELAY, delays: Column | None = None) -> DataFrame:
    """requests with start: the earliest start of each, at least delay seconds after its predecessor's in the domain.

    start_i = i * d + max over j <= i of (arrival_j - j * d): one window, no loop. delays gives a delay constant in a
    domain, such as a crawl-delay, instead.
    """
    d = delays if delays is not None else F.lit(delay)
    lane = Window.partitionBy(domain).orderBy(arrival, order)
    i = (F.row_number().over(lane) - 1).cast("double")
    numbered = requests.withColumn("_i", i).withColumn("_d", d)
    slack = F.max(F.col(arrival) - F.col("_i") * F.col("_d")).over(lane.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", slack + F.col("_i") * F.col("_d")).drop("_i", "_d")


@dataclass
class Breaker:
    """State of one domain: consecutive failures, and until when it is blocked (0: not)."""

    failures: int = 0
    open_until: float = 0.0

    def step(self, ts: float, outcome: str | None, threshold: int, cooldown: float) -> tuple[bool, str]:
        """Whether a request at ts is allowed, and the state after its outcome (success, failure or anything else).

        After the cooldown a request is allowed and the count of failures stays, so one more failure blocks again. A
        blocked request has no outcome.
        """
        if self.open_until > 0 and ts < self.open_until:
            return False, "open"
        trial = self.open_until > 0
        self.open_until = 0.0
        if outcome == "success":
            self.failures = 0
        elif outcome == "failure":
            self.failures += 1
            if self.failures >= threshold:
                self.open_until = ts + cooldown
        return True, "open" if self.open_until > 0 else "half_open" if trial and self.failures else "closed"


def outcome(status: Column, ok: Column) -> Column:
    """failure: status 500 and above or none; success: 304 or accepted HTML; else other, which leaves the state alone."""
    return F.when((status >= 500) | status.isNull() | (status == 0), "failure").when((status == 304) | ok, "success").otherwise("other")


def breaker(events: DataFrame, domain: str = "domain", ts: str = "ts", result: str = "outcome", order: str = "event_id", threshold: int = FAILURES, cooldown: float = COOLDOWN) -> DataFrame:
    """(domain, event_id, ts, allowed, state, failures) for each event, in order of ts (seconds) within its domain.

    Rows of one domain are read in sorted Arrow batches with a few numbers of state, however many they are.
    """

    def run(batches):
        key, state = object(), Breaker()
        for frame in batches:
            rows = []
            for d, t, o, e in zip(frame["domain"], frame["ts"], frame["outcome"], frame["event_id"]):
                if d != key:
                    key, state = d, Breaker()
                allowed, name = state.step(t, o, threshold, cooldown)
                rows.append((d, e, t, allowed, name, state.failures))
            yield pd.DataFrame(rows, columns=["domain", "event_id", "ts", "allowed", "state", "failures"])

    given = events.select(F.col(domain).cast("string").alias("domain"), F.col(ts).cast("double").alias("ts"), F.col(result).alias("outcome"), F.col(order).cast("long").alias("event_id"))
    return given.repartition("domain").sortWithinPartitions("domain", "ts", "event_id").mapInPandas(run, "domain string, event_id long, ts double, allowed boolean, state string, failures int")


def breaker_stats(trail: DataFrame) -> DataFrame:
    """(domain, failures, open, trips) after the last event of each domain."""
    last = F.max_by(F.struct("failures", "state"), F.struct("ts", "event_id"))
    trips = F.sum((F.col("allowed") & (F.col("state") == "open")).cast("long"))
    out = trail.groupBy("domain").agg(last.alias("l"), trips.alias("trips"))
    return out.select("domain", F.col("l.failures").alias("failures"), (F.col("l.state") == "open").alias("open"), "trips")
