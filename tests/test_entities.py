"""Entities: Viterbi against all sequences, training, the gazetteer against a plain search."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import entities, extract

LABELLED = "tokens array<string>, tags array<string>"


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_against_all_sequences(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 6)), int(rng.integers(1, 5))
    emission, transition = rng.normal(size=(n, k)), rng.normal(size=(k + 1, k))
    if seed % 3 == 0:
        transition[0, k - 1] = -1e9
    score = lambda path: sum(emission[i, t] for i, t in enumerate(path)) + sum(transition[a, b] for a, b in itertools.pairwise([k, *path]))
    best = max(map(score, itertools.product(range(k), repeat=n)))
    assert abs(score(entities.viterbi(emission, transition)) - best) < 1e-9
    assert entities.viterbi(emission[:0], transition) == []


@pytest.fixture(scope="module")
def model(spark):
    return entities.default_model(spark)


def found(spark, text, **how):
    run = entities.recogniser(spark, **how)
    return spark.createDataFrame([(text,)], "text string").select(run(F.col("text")).alias("e")).first()["e"]


def test_model_on_sentences_it_has_not_seen(spark, model):
    assert found(spark, "Angela Merkel visited Paris.", model=model) == {"PERSON": ["Angela Merkel"], "GPE": ["Paris"]}
    got = found(spark, "Sarah Jones met Tom Baker in Rome on 4 June 2018. Sarah Jones works for Initech Corp. It was late and nobody was there.", model=model)
    assert got["PERSON"] == ["Sarah Jones", "Tom Baker"] and got["GPE"] == ["Rome"] and got["DATE"] == ["4 June 2018"] and got["ORG"] == ["Initech Corp"]
    assert found(spark, "The harvest was good and the roads were dry.", model=model) == {}
    assert found(spark, "", model=model) == found(spark, None, model=model) == {}


def test_training_in_partitions(spark):
    """Sentences in several partitions, some of them odd, give a model that knows its training sentences."""
    rows = entities.marked(each=6)
    odd = [(None, None), ([], []), (["a"], ["O", "O"]), (["a"], ["X-Y"])]
    m = entities.train(spark.createDataFrame([*rows, *odd], LABELLED).repartition(3), rounds=8)
    right = sum([entities.TAGS[t] for t in m.tags(w)] == g for w, g in rows)
    assert right / len(rows) > 0.9
    none = entities.train(spark.createDataFrame([], LABELLED), rounds=1)
    assert none.mentions("Angela Merkel visited Paris.") == []


def test_a_mention_goes_on_only_after_its_label():
    rng = np.random.default_rng(2)
    m = entities.Model(rng.normal(size=(entities.BUCKETS, len(entities.TAGS))), rng.normal(size=(len(entities.TAGS) + 1, len(entities.TAGS))))
    tags = [entities.TAGS[t] for t in m.tags([f"w{k}" for k in range(60)])]
    assert all(t[0] != "I" or before[2:] == t[2:] for before, t in itertools.pairwise(["O", *tags]))


PHRASES = [("GPE", "New York"), ("GPE", "York"), ("ORG", "New York Times"), ("PERSON", "Ann"), ("PRODUCT", "Ann"), ("LOC", "Rhône"), (None, "x"), ("GPE", None), ("GPE", " - "), ("GPE", "C++"), ("GPE", "New York")]


def test_gazetteer_against_a_plain_search(spark):
    held = entities.gazetteer(spark.createDataFrame(PHRASES, "label string, phrase string"))
    texts = ["The New York Times of New York, York", "Annabel and Ann, _Ann Ann_ Ann2 Ann", "le Rhône, Rhônes; C++ C+++ xC++", None, "", "Ann " * 3000]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id int, text string, label string")
    got = sorted((r["doc_id"], r["start"], r["end"], r["label"], r["phrase"]) for r in entities.gazetteer_hits(docs, held).collect())
    want = []
    for k, t in enumerate(texts):
        for label, phrase in {(a, b) for a, b in PHRASES if a and b and re.search(r"\w", b)}:
            for m in re.finditer(f"(?={re.escape(phrase)})", t or ""):
                a, b = m.start(), m.start() + len(phrase)
                if not re.match(r"\w\w", t[max(a - 1, 0) : a + 1] if a else "") and not re.match(r"\w\w", t[b - 1 : b + 1]):
                    want.append((k, a, b, label, phrase))
    assert got == sorted(want)
    assert found(spark, texts[0], held=held) == {"ORG": ["New York Times"], "GPE": ["New York", "York"]}
    assert found(spark, "Ann", held=held) == {"PERSON": ["Ann"], "PRODUCT": ["Ann"]}


def test_gazetteer_goes_before_the_model_and_is_bounded(spark, model):
    held = entities.gazetteer(spark.createDataFrame([("ORG", "Paris")], "label string, phrase string"))
    assert found(spark, "Angela Merkel visited Paris.", model=model, held=held) == {"PERSON": ["Angela Merkel"], "ORG": ["Paris"]}
    with pytest.raises(ValueError, match="too large"):
        entities.gazetteer(spark.createDataFrame([("ORG", "Paris")], "label string, phrase string"), most=3)
    pages = spark.createDataFrame([(1, "https://x.example/", "<body><article><p>Angela Merkel visited Paris.</p></article>")], "page_id long, url string, html string")
    assert extract.extract(pages, ner=entities.recogniser(spark, model)).first()["content"]["entities"] == {"PERSON": ["Angela Merkel"], "GPE": ["Paris"]}
