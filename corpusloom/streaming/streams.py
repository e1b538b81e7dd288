"""Streaming twins: circuit breaker, seen set, greedy dedup, rates and batched sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..functions.session import cut
from ..operators import dedup, state
from ..sources import store


def breaker(events: DataFrame, threshold: int = state.FAILURES, cooldown: float = state.COOLDOWN) -> DataFrame:
    """The circuit breaker over a stream of (domain, event_id, ts seconds, outcome): the same rows as in batch.

    Keyed state of two numbers per domain. Within a micro-batch a domain's events apply in order of ts.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own = state.Breaker(*held.get) if held.exists else state.Breaker()
        for frame in [pd.concat(list(frames))]:
            rows = []
            for e, t, o in sorted(zip(frame["event_id"], frame["ts"], frame["outcome"]), key=lambda r: (r[1], r[0])):
                allowed, name = own.step(t, o, threshold, cooldown)
                rows.append((key[0], e, t, allowed, name, own.failures))
            yield pd.DataFrame(rows, columns=["domain", "event_id", "ts", "allowed", "state", "failures"])
        held.update((own.failures, own.open_until))

    return events.groupBy("domain").applyInPandasWithState(run, "domain string, event_id long, ts double, allowed boolean, state string, failures int", "failures int, open_until double", "append", GroupStateTimeout.NoTimeout)


def first_seen(urls_: DataFrame, key: str = "url", ts: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key. With an event time the state of keys is dropped after the watermark."""
    return urls_.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts else urls_.dropDuplicates([key])


def rate(events: DataFrame, ts: str, label: str, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """(window_start, label, rate) in tumbling windows of event time."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), F.col(label).alias("label")).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))
    return out.select(F.col("w.start").alias("window_start"), "label", "rate")


KEPT_SCHEMA = "doc_id long, hash string, simhash long, batch int"


def judge_batch(batch: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(verdicts, kept): greedy first-come dedup of one batch against known(doc_id, hash, simhash), the kept texts of earlier ones.

    Verdicts are (doc_id, is_dup, reason), one for each row; kept has the marks of texts that this batch adds. As in the batch cascade, a null text counts as
    an empty one, rows without an id come last in their batch, and of rows that repeat an id and a text one is the first.
    """
    marked = cut(batch.select(F.col(doc_id).alias("doc_id"), tx.content_hash(F.col(text)).alias("hash"), tx.simhash(F.col(text)).alias("simhash")))
    rows = marked.groupBy("doc_id", "hash", "simhash").agg(F.count("*").alias("n"))
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("rep"), "hash", "doc_id")
    nodes = cut(rows.groupBy("simhash").agg(F.min(place).alias("first")))
    # Kept texts are before all new ones and don't match each other. Of them only those that share a key with a new one take part.
    old = known.groupBy("simhash").agg(F.min("hash").alias("hash"))
    keys = lambda df: df.select("simhash", F.explode(dedup.block_keys()).alias("key"))
    near_old = cut(keys(old).join(keys(nodes).select("key").distinct(), "key", "left_semi").select("simhash").distinct().join(old, "simhash"))
    new = nodes.join(near_old, "simhash", "left_anti")
    both = near_old.select(F.col("simhash").alias("node"), "simhash", F.lit(-(2**63)).alias("rep")).unionByName(new.select(F.col("simhash").alias("node"), "simhash", "first.rep"))
    state = dedup.greedy(both).where("kept").select(F.col("node").alias("simhash"))
    kept = cut(new.join(state, "simhash").select("first.doc_id", "first.hash", "simhash"))
    # Equal texts have equal simhashes, of which one text is kept at most.
    owners = near_old.select("simhash", F.col("hash").alias("h"), F.lit(None).cast("long").alias("d"), F.lit(False).alias("fresh")).unionByName(kept.select("simhash", F.col("hash").alias("h"), F.col("doc_id").alias("d"), F.lit(True).alias("fresh")))
    out = rows.join(owners, "simhash", "left")
    first = F.coalesce(F.col("fresh") & (F.col("hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), F.lit(False))
    why = F.when(F.col("hash") == F.col("h"), "exact").otherwise("near")
    judged = out.select("doc_id", first.alias("first"), why.alias("why"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    is_dup = ~(F.col("first") & (F.col("k") == 1))
    return judged.select("doc_id", is_dup.alias("is_dup"), F.when(~is_dup, "").otherwise(F.col("why")).alias("reason")), kept


def dedup_batches(path: str, doc_id: str = "doc_id", text: str = "text") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: greedy first-come dedup against the kept table under path, then within the batch.

    Verdicts go to path/verdicts and kept texts' marks (id, hash, simhash) to path/kept, one folder for each batch, overwritten if a
    batch is run again; so a rerun after a failure gives the same rows. Micro-batches come in order of their ids.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(KEPT_SCHEMA).parquet(f"{path}/kept").where(F.col("batch") < number) if number else spark.createDataFrame([], KEPT_SCHEMA)
        verdicts, kept = judge_batch(batch, known, doc_id, text)
        verdicts.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        kept.write.mode("overwrite").parquet(f"{path}/kept/batch={number}")

    return run


def upsert_batches(path: str, mode: str = "upsert", key: str = "url", seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table's versions are path/v=N; batch N makes version N from N - 1, again if it is rerun."""

    def run(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/v={number - 1}") if number else None
        new = store.upsert(old, batch, key, seq) if mode == "upsert" else store.replace(old, batch, key, seq)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
