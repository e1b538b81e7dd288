"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again by the next.

Stages: low-quality documents go; one document of each group of near copies stays (five-word shingles with a Jaccard similarity
of 0.8 or more); contaminated documents go; sources are mixed to target weights (documents repeat as the mix takes them);
rows are sharded. All but the last return the columns of documents. Decisions use only their stage's input and, for the classifier and
the benchmark, the tables beside it.

Edge cases: a null text is kept or dropped as an empty one would be. Extra columns pass through. Very long texts are read whole by each stage.
Rows with equal texts are one group, of which the smallest id stays; if several rows have it, one of them. Ties elsewhere change nothing: equal
texts are scored, judged and counted alike. An empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.session import checkpoint_folder
from corpusloom.llm import decontaminate, mixing, quality, sharding, shingles
from corpusloom.llm.sparkutil import fresh, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return quality.scored(docs, model, to=score).where(F.col(score) >= 0.3).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates by op8's links (fingerprints, Golay keys, four bits) over five words; MinHash bands for pairs beyond their reach, and exact sets decide (see README)."""
    return shingles.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first stage's network is beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL: str | None = None


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written to its end: its folder has the mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of sf_dir.

    Each stage but the last is written as Parquet under folder, which driver and executors share; without one, under a new
    folder in spark.checkpoint.dir. Given the folder of a run that broke off, stages that were written to their end are read and not
    run again.
    """
    folder = folder or f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        if not _finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
