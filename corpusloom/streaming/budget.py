"""Running budgets of domains over a stream, in keyed state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import frontier

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GRANTS = "domain string, id long, ts timestamp, place long, allowed boolean"


class Budget(StatefulProcessor):
    """Grants a domain's requests, by (ts, id) within a micro-batch, until its budget of the period is used.

    State of a domain: the number of grants in each open period. A task holds no more rows of a domain than it may still grant, and one
    batch of Arrow rows: a request that falls behind is refused at once, so a domain with a third of all rows needs no more memory.
    """

    def __init__(self, timed: bool, idle_ms: int | None) -> None:
        self.timed, self.idle_ms = timed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "period long", "n long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, pd.DataFrame] = {}
        used: dict[int, int] = {}
        for frame in rows:
            for period, own in frame.groupby("period"):
                period = int(period)
                if period not in used:
                    used[period] = self.used.getValue((period,))[0] if self.used.containsKey((period,)) else 0
                if period in held:
                    own = pd.concat([held[period], own])
                own = own.sort_values(["ts", "id"], na_position="last", kind="stable")
                left = max(0, int(own["budget"].iloc[0]) - used[period])
                held[period] = own.iloc[:left]
                if len(own) > left:
                    yield self._out(key, own.iloc[left:], None)
        for period, own in held.items():
            if len(own):
                yield self._out(key, own, used[period])
                self.used.updateValue((period,), (used[period] + len(own),))
                if self.timed:
                    self.handle.registerTimer(int(own["period_end"].iloc[0]))

    def _out(self, key, own: pd.DataFrame, used: int | None) -> pd.DataFrame:
        place = [None] * len(own) if used is None else range(used + 1, used + 1 + len(own))
        out = pd.DataFrame({"domain": key[0], "id": own["id"].to_numpy(), "ts": own["ts"].to_numpy()})
        return out.assign(place=pd.array(list(place), dtype="Int64"), allowed=used is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the end of a period: no request of it can come any more, its count goes."""
        end = expiredTimerInfo.getExpiryTimeInMs()
        for (period,) in list(self.used.keys()):
            if period < end:
                self.used.removeKey((period,))
        return iter([])

    def close(self) -> None:
        pass


def grants(
    requests: DataFrame, domain: str = "domain", id: str = "id", ts: str = "ts", period: int | None = None, late: str = "10 minutes", idle_seconds: int | None = None, **how
) -> DataFrame:
    """(domain, id, ts, place, allowed) of each request of a stream: place counts a domain's grants from 1, null if refused.

    how: overrides, tiers and default as in frontier.budgets. With a period (seconds) each period of event time has the budget anew, and a
    timer clears its count once the watermark (ts less `late`) has passed its end; requests later than that are dropped by it. With
    idle_seconds a domain that got no grant for so long, by the clock, starts anew; such a stream runs empty batches on and on, so under
    availableNow it only ends with spark.sql.streaming.noDataMicroBatches.enabled false. Neither: counts stay for good. Rows without a domain share one budget,
    under an empty name, rows without a time come last in their micro-batch and belong to the period of 1970; repeated ids are
    requests of their own. The stream needs the RocksDB state store (see `state_store`).
    """
    if period and idle_seconds:
        raise ValueError("a period or idle_seconds, not both")
    stamp = F.col(ts).cast("timestamp")
    rows = requests.select(F.coalesce(F.col(domain), F.lit("")).alias("domain"), F.col(id).cast("long").alias("id"), (F.coalesce(stamp, F.timestamp_seconds(F.lit(0))) if period else stamp).alias("ts"))
    length = (period or 0) * 1000
    start = F.floor(F.unix_millis("ts") / F.lit(length)) * length if period else F.lit(0)
    rows = rows.withColumn("period", start.cast("long")).withColumn("period_end", F.col("period") + length)
    if period:
        rows = rows.withWatermark("ts", late)
    rows = frontier.budgets(rows, **how)
    mode = "EventTime" if period else "ProcessingTime" if idle_seconds else "None"
    return rows.groupBy("domain").transformWithStateInPandas(Budget(bool(period), idle_seconds and idle_seconds * 1000), GRANTS, "append", mode)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within use the state store that keyed state with timers and times to live needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
