"""The two classifiers: plain forward passes, and training that no long text, repeated id or null can void."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import quality, samples, toxicity

WORDS = ["river", "stone", "cloud", "paper", "light", "green", "horse", "table", "music", "bread"]


def labelled(n=240):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for k in range(n):
        own = rng.choice(WORDS, 30).tolist()
        if k % 4 == 0:
            for at in rng.choice(30, 3, replace=False):
                own[int(at)] = "idiot"
        docs.append((k, "!! ".join(own).upper() if k % 5 == 0 else " ".join(own) + "."))
        labels.append((k, int(k % 5 != 0), int(k % 4 == 0)))
    return docs, labels


def trains_on(i, modulus, out):
    return zlib.crc32(str(i).encode()) % modulus != out


@pytest.mark.parametrize("what", ["long text", "repeated id", "null ids"])
def test_training_cannot_be_voided(spark, what):
    docs, labels = labelled()
    ids = [k for k, _ in docs if trains_on(k, 5, 0) and trains_on(k, 3, 1)]
    if what == "long text":
        docs[ids[0]] = (ids[0], "river stone cloud paper light. " * 1_700_000)  # 50 MB
    elif what == "repeated id":
        docs += [docs[ids[1]]] * 10_000
    else:
        docs += [(None, "idiot " * 40)] * 50
        labels += [(None, 1, 1), (None, 0, 0), (ids[2], None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    small = spark.createDataFrame([r for r in docs if len(r[1]) < 10**6][:240], "doc_id long, text string")
    model = quality.fit(frame, marks, limit=2000)
    assert isinstance(model, quality.AttentionModel)
    want = {i: q for i, q, _ in labels if i is not None and q is not None}
    got = [(want[r["doc_id"]], r["score"]) for r in quality.scored(small, model).collect()]
    assert np.mean([(s >= 0.3) == y for y, s in got]) > 0.95
    model = toxicity.fit(frame, marks, words=20_000)
    assert isinstance(model, toxicity.SubwordModel)
    want = {i: t for i, _, t in labels if i is not None and t is not None}
    got = [(want[r["doc_id"]], r["score"]) for r in toxicity.scored(small, model).collect()]
    assert np.mean([(s >= 0.7) == y for y, s in got]) > 0.95


def test_level_and_excerpt():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(0, 1000, rng.integers(1, 20))
        total = int(rng.integers(20, 8000))
        most = samples.level(sizes, total)
        assert np.minimum(sizes, most).sum() <= max(total, len(sizes))
        assert sizes.sum() <= total or np.minimum(sizes, most + 1).sum() > total
    text = " ".join(f"w{k}" for k in range(100_000))
    cut = samples.excerpt(text, 8000)
    own = cut.split()
    assert 6000 < len(cut) <= 8000 and set(own) <= set(text.split())
    assert int(own[0][1:]) < 10_000 and int(own[-1][1:]) > 90_000
    assert samples.excerpt("short", 8000) == "short" and samples.excerpt("x" * 9000, 100)


def test_quality_forward_pass():
    """Score of the network, passage by passage, in plain Python."""
    rng = np.random.default_rng(2)
    model = quality.AttentionModel(np.full(quality.WIDTH, 0.1), np.full(quality.WIDTH, 0.5))
    n = np.array([2, 0, 3])
    x = rng.random((5, quality.WIDTH)).astype(np.float32)
    got = model.score(x, n)
    p, at, dot = model.p, 0, lambda a, b: sum(float(i) * float(j) for i, j in zip(a, b))
    for want, k in zip(got, n):
        h = [[math.tanh(dot((r - 0.1) / 0.5, p["E"][:, j]) + float(p["e"][j])) for j in range(quality.HIDDEN)] for r in x[at : at + k]]
        a = [sum(float(p["w"][j]) * math.tanh(dot(v, p["V"][:, j])) / (1 + math.exp(-dot(v, p["U"][:, j]))) for j in range(quality.ATTENTION)) for v in h]
        e = [math.exp(v) for v in a]
        z = [sum(w * v[j] for w, v in zip(e, h)) / sum(e) for j in range(quality.HIDDEN)] if k else [0.0] * quality.HIDDEN
        assert math.isclose(want, 1 / (1 + math.exp(-dot(z, p["c"]) - float(p["b"][0]))), rel_tol=1e-4)
        at += k


def test_passages_in_steps(monkeypatch):
    texts = [b"some Text, 12.", b"", b"a b " * 2000]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    whole, n = quality.passages(data, offsets)
    monkeypatch.setattr(quality, "_STEP", 3)
    assert (quality.passages(data, offsets)[0] == whole).all() and n.tolist() == [1, 0, 16]


def test_toxicity_forward_pass():
    """Pooled logits from words and n-grams in plain Python."""
    rng = np.random.default_rng(3)
    model = toxicity.SubwordModel(rng.standard_normal(toxicity.BUCKETS), 0.25)
    text = " ".join([*(f"{w}{k % 7}" for k, w in enumerate(WORDS * 5)), "river0", "i.d.iot!"])

    def weight(word):
        _, _, _, bucket = toxicity.bags([word])
        codes = [0, *map(ord, word), 0]
        assert len(bucket) == sum(max(0, len(codes) - n + 1) for n in toxicity.NGRAMS) + toxicity.WHOLE
        return float(np.mean(model.weights[bucket]))

    words = [w.strip("!") for w in text.split()]
    k = -(-len(words) // toxicity.PASSAGE)
    cut = [words[j * len(words) // k + (j * len(words) % k > 0) : (j + 1) * len(words) // k + ((j + 1) * len(words) % k > 0)] for j in range(k)]
    means = [sum(map(weight, set(c))) / max(len(set(c)), toxicity.LEAST_WORDS) for c in cut]
    got = model.pooled([text, ""])
    assert np.allclose(got[0], [toxicity.SCALE * max(means) + 0.25, toxicity.SCALE * np.mean(means) + 0.25, math.log(1 + k), 1], rtol=1e-4)
    assert np.allclose(got[1], [0.25, 0.25, 0, 1])


def test_toxicity_pieces():
    text = "word " * 100_000 + "x" * 300_000 + " end"
    parts = toxicity.pieces(text, 1000)
    assert "".join(parts) == text and max(map(len, parts)) <= 2001
    model = toxicity.SubwordModel(np.random.default_rng(3).standard_normal(toxicity.BUCKETS), 0.0)
    assert np.isfinite(model.score([text * 4])).all()
