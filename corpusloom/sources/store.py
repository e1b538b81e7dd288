"""Storage semantics on DataFrames: upserts, insert-ignore, event log, search documents and an inverted index.

Each returns the table's new content; write_table writes any of them. Batches carry a sequence number: within one batch
rows of a key apply in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Columns that a repeated url updates; all others keep the first value. The older set beside it.
UPDATED = ("final_url", "title", "body", "article", "language", "content_hash", "entities", "schema_org", "rendered_by", "scraped_at")
UPDATED_OLD = ("final_url", "title", "body", "status_code", "content_hash", "simhash", "rendered_by", "scraped_at")
WAL_SCHEMA = "event string, url string, detail string, ts double"


def _ordered(existing: DataFrame | None, batch: DataFrame, seq: str) -> DataFrame:
    rows = batch.withColumn("_o", F.col(seq).cast("long")).drop(seq)
    if existing is not None:
        old = existing.drop(seq).withColumn("_o", F.lit(-(2**62)).cast("long"))
        rows = old.unionByName(rows, allowMissingColumns=True)
    return rows


def upsert(existing: DataFrame | None, batch: DataFrame, key: str = "url", seq: str = "seq", updated: tuple[str, ...] = UPDATED) -> DataFrame:
    """Insert; for a known key only the updated columns take the last value, the others keep the first.

    One aggregation with partial sums: no sort, and a key with many rows is no task of its own.
    """
    rows = _ordered(existing, batch, seq)
    picks = [F.max_by(F.struct(c), "_o")[c].alias(c) if c in updated else F.min_by(F.struct(c), "_o")[c].alias(c) for c in rows.columns if c not in (key, "_o")]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*picks)


def replace(existing: DataFrame | None, batch: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """Insert or replace: the last row of each key, whole."""
    rows = _ordered(existing, batch, seq)
    others = [c for c in rows.columns if c not in (key, "_o")]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), "_o").alias("_r"))
    return last.select(key, "_r.*")


def insert_ignore(existing: DataFrame | None, batch: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of the batch whose key is new, the first of each: what is to be appended."""
    others = [c for c in batch.columns if c not in keys and c != order]
    if others:
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*others), order or others[0]).alias("_r")).select(*keys, "_r.*")
    else:
        first = batch.select(*keys).distinct()
    return first.join(existing.select(*keys), keys, "left_anti") if existing is not None else first


def wal(events: DataFrame) -> DataFrame:
    """Rows of the event log from events(event, url, detail, ts): fetched, stored, error or skipped; ts defaults to now."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    return events.select("event", "url", F.coalesce("detail", F.lit("")).alias("detail"), F.when(F.coalesce(F.col("ts"), F.lit(0.0)) == 0, now).otherwise(F.col("ts")).alias("ts"))


def fetched_detail(status: Column, ms: Column) -> Column:
    return F.format_string("status=%d ms=%.0f", status.cast("int"), ms.cast("double"))


def append_wal(events: DataFrame, path: str) -> None:
    wal(events).write.mode("append").option("ignoreNullFields", "false").json(path)


def replay_wal(spark: SparkSession, path: str) -> DataFrame:
    """All events of the log; blank and malformed lines are skipped. A missing log is an error that the caller may test for."""
    read = spark.read.schema(f"{WAL_SCHEMA}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where("_bad IS NULL AND event IS NOT NULL").drop("_bad")


def search_documents(pages: DataFrame) -> DataFrame:
    """(id, document): the ten fields of the search index as JSON, keyed by url."""
    given = [
        "url", "title", F.coalesce(F.nullif("article", F.lit("")), F.col("text")).alias("article"), "author", F.nullif("date", F.lit("")).alias("date"), "language", "entities", "schema_org", "scraped_at",
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1).alias("domain"),
    ]
    return pages.select(*given).select(F.col("url").alias("id"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def inverted_index(pages: DataFrame, key: str = "url", fields: tuple[str, ...] = ("title", "article", "body")) -> DataFrame:
    """(term, key, tf) of the fields' tokens."""
    whole = F.concat_ws(" ", *fields)
    return pages.select(F.col(key).alias("key"), F.explode(tx.tokens(whole)).alias("term")).groupBy("term", "key").agg(F.count("*").alias("tf"))


def search(index: DataFrame, terms: list[str], n_docs: int) -> DataFrame:
    """(key, score) of the documents with any of the terms, by the sum of tf * ln(1 + n / df)."""
    hits = index.where(F.col("term").isin(*[t.lower() for t in terms]))
    weight = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(weight, "term").groupBy("key").agg(F.sum(F.col("tf") * F.log(1 + F.lit(float(n_docs)) / F.col("df"))).alias("score"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).save(path)
