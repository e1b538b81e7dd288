"""The pipeline's near-dedup stage against all comparisons of five-word shingles."""

from __future__ import annotations

import collections
import itertools
import os

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import shingles, simhash

SCHEMA = "doc_id long, text string, n long"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    sets = [shingle_set(t) for t in texts]
    near = np.array([[not (a or b) or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    low = np.arange(len(texts))
    while not ((new := np.array([low[n].min() for n in near])) == low).all():
        low = new
    return low.tolist()


def test_near_copies(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"{a}{b}" for a in ("ri", "sto", "clo", "pa", "li", "gre") for b in ("ver", "ne", "ud", "per", "ght", "en", "sk")])
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for _ in range(40):
        own = rng.choice(vocabulary, 80)
        texts.append(" ".join(own))
        for changes in rng.integers(0, 4, 4):
            copy = own.copy()
            copy[rng.integers(0, 80, changes)] = "other"
            texts.append("  ".join(copy))
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], SCHEMA)
    want = collections.Counter(set(groups(texts)))
    assert len(want) < len(texts) - 60
    for block, cell in ((shingles.BLOCK, shingles.CELL), (2, 150)):
        assert collections.Counter(r["doc_id"] for r in shingles.keep_one(docs, block=block, cell=cell).collect()) == want
    stage = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert stage.columns == docs.columns and collections.Counter(r["doc_id"] for r in stage.collect()) == want
    assert simhash.keep_one(docs).count() > len(want)


def test_ids(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(1, a, 0), (1, b, 1), (2, b, 2), (1, a, 3), (None, c, 4), (None, c, 5), (None, a, 6), (3, a, 7)]
    out = shingles.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("1", a), ("1", b), ("None", c)]
    assert shingles.keep_one(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_odd_tables(spark):
    """Texts of very different lengths, columns that clash with the operator's own, ties at the threshold."""
    words = [f"w{k}" for k in range(30_000)]
    long, tie = " ".join(words), " ".join(words[:13])
    rows = [(1, long, 0), (2, " ".join([*words[:-1], "other"]), 1), (3, tie, 2), (4, " ".join([*words[:12], "x"]), 3), (5, " ".join(words[:14]), 4), (6, None, 5), (7, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("doc_id", "text", "n", "1 AS hash", "2 AS sid", "3 AS low", "4 AS keys", "5 AS _hash", "6 AS _n")
    out = shingles.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 6]  # 9 of 9 + 1 shingles, 8 of 9 + 9 - 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_on_documents(spark):
    """Every pair of different texts of the table at a similarity of 0.8 or more is in one family before the exact comparison, and in one group after."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {k: frozenset(shingle_set(t)) for k, t in texts.items()}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    shared = collections.Counter()
    for own in holders.values():
        shared.update((a, b) for a, b in itertools.combinations(sorted(own), 2))
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    different = [p for p in near if sets[p[0]] != sets[p[1]]]
    low = dict(zip(texts, texts))
    while True:
        before = dict(low)
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    empty = [k for k, s in sets.items() if not s]
    want = {low[k] for k in texts if k not in empty} | set(sorted(empty)[:1])
    kept = {r["doc_id"] for r in shingles.keep_one(docs).collect()}
    assert len(different) > 10 and kept == want


def test_fingerprints_give_candidates(spark):
    """Without MinHash bands op8's method alone, over five words, finds close copies: all whose fingerprints are within four bits, in one group by exact sets."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    texts = [None, "", "a b c"]
    for _ in range(60):
        own = rng.choice(vocabulary, 400)
        texts.append(" ".join(own))
        for changes in (1, 2):
            copy = own.copy()
            copy[rng.integers(0, 400, changes)] = "other"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], SCHEMA)
    data = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    h, n = shingles.shingle_sets(np.concatenate(data), np.cumsum([0, *map(len, data)]))
    fp = np.array(shingles.fingerprints(h, n).fill_null(0).to_pylist()).view(np.uint64)
    kept = {r["doc_id"] for r in shingles.keep_one(docs, bands=0).collect()}
    firsts = set(groups(texts))
    near = [k for k in range(3, len(texts)) if (k - 3) % 3 and np.bitwise_count(fp[k] ^ fp[k - (k - 3) % 3]) <= 4]
    assert len(near) > 60 and firsts <= kept and not kept & set(near)
    assert shingles.fingerprints(h, n)[1].as_py() is None
