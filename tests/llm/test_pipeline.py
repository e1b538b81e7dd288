"""The corpus pipeline's stages, each against a plain version on its own input, with nulls, copies and an extra column."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, quality
from corpusloom.llm.sparkutil import table

from test_near_dedup import groups as jaccard_groups


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ri", "sto", "clo", "pa", "li", "gre") for b in ("ver", "ne", "ud", "per", "ght", "en", "sk")]
    bench = " ".join(rng.choice(words, 40))
    docs, labels = [], []
    for k in range(240):
        text = " ".join(rng.choice(words, 60)) + "."
        if k % 6 == 0:
            text = text.replace(" ", "!! ").upper()
        if k % 10 == 1:
            text = f"{text} {bench}"
        docs.append((k, text, "en", f"s{k % 4}" if k % 7 else None, len(text), f"x{k}"))
        labels.append((k, int(k % 6 != 0), 0))
    docs += [docs[5], (300, docs[5][1], "en", "s1", 1, None), (301, docs[7][1].replace(".", " end."), "en", "s1", 1, None), (302, None, None, None, None, None), (303, "", "", "", 0, ""), (None, "a lone text without an id", "en", "s0", 1, "n")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        steps[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))

    before, after = steps["quality"]
    model = quality.fit(before, table(spark, sf_dir, "labels"))
    assert rows(after) == rows(quality.scored(before, model, to="_s").where("_s >= 0.3").select(before.columns))
    bad = {r["doc_id"] for r in after.where("doc_id < 240 AND doc_id % 6 = 0").collect()}
    assert len(bad) <= 2

    before, after = steps["near_dedup"]
    marked = [(r["doc_id"], r["text"]) for r in before.collect()]
    groups = collections.defaultdict(list)
    for (i, _), g in zip(marked, jaccard_groups([t for _, t in marked])):
        groups[g].append(i)
    assert len(groups) < len(marked) - 2
    want = collections.Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert collections.Counter(r["doc_id"] for r in after.collect()) == want
    assert not rows(after) - rows(before)

    before, after = steps["decontamination"]
    bench = table(spark, sf_dir, "benchmark")
    assert decontaminate.scan(after, bench).where(decontaminate.contaminated(F.col("n_words"), decontaminate.n_hit())).count() == 0
    gone = rows(before) - rows(after)
    assert gone and not rows(after) - rows(before)
    passage = bench.first()["text"].split()
    assert all(any(" ".join(passage[k : k + 13]) in r[1] for k in range(28)) for r in gone)

    before, after = steps["mixing"]
    sizes, taken = collections.Counter(), collections.Counter()
    for frame, count in ((before, sizes), (after, taken)):
        for r in frame.collect():
            count[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert set(rows(after)) <= set(rows(before)) and max(rows(after).values()) <= 3
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.1 * sum(sizes.values())

    before, after = steps["sharding"]
    assert after.count() == before.count()
    slots = collections.defaultdict(list)
    for r in after.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_resumes(spark, sf_dir, tmp_path, monkeypatch):
    whole = rows(corpus_pipeline.run(spark, sf_dir, str(tmp_path / "run")))
    assert sum(whole.values()) > 100

    def broken(*_):
        raise AssertionError("a finished stage was run again")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, broken) for n, _ in corpus_pipeline.STAGES[:-1]] + corpus_pipeline.STAGES[-1:])
    assert rows(corpus_pipeline.run(spark, sf_dir, str(tmp_path / "run"))) == whole


def test_empty_and_only_nulls(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    nulls = spark.createDataFrame([(None,) * 6] * 3, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, nulls, sf_dir).count() <= 3


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
