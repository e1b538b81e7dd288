"""Article bodies without <article>, and trained language models, against plain versions."""

from __future__ import annotations

import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import extract, language

A = "The river carried the boats slowly down to the harbour, where people waited, and sang."
B = "Nobody had expected the weather to change, yet by noon the clouds were gone."
C = "At last, after a long day, the travellers found a place to rest and eat."
NAV = "<ul><li><a href=/>Home page of it all</a></li><li><a href=/x>Another page, of others</a></li></ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div>{NAV}</div><div><div><h1>Head</h1><p>{A}</p><p>{B}</p></div></div>", ["Head", A, B]),
        (f"<body>{NAV}<div class=x><p>{A}<p>{B}<p>{C}</div>{NAV}", [A, B, C]),
        (f"<body><table><tr><td>{NAV}<td><p>{A}</p>{NAV}<p>{B}</p></table>", [A, B]),
        (f"<body><h2>Head</h2><section><p>{A}</p></section><section><p>{B}</p></section><div>{NAV}</div>", ["Head", A, B]),
        (f"<body><div>{A}<br>{B}</div><div class='sidebar-box'><p>{C}</p></div>", [A, B]), (f"<body>{A}<br>{B}<div class='sidebar-box'><p>{C}</p></div>", [A, B]),
        (f"<body><div id=ad><p>{C}</p></div><div><p>Short.</p></div>", ["Short."]),
        (f"<body><article><p>{A}</p></article><div><p>{B}</p><p>{C}</p></div>", [A]),
        (f"<body><div class=comment><p>{A}</p></div>", [A]),  # nothing else is there
        ("<body><nav>x</nav>", []), ("", []), (None, []), ("plain text", ["plain text"]),
    ],
)
def test_article(page, want):
    assert extract.parse_page(page)["article"] == " ".join(want)


def test_article_of_deep_and_broken_pages():
    deep = "<div>" * 3000 + f"<p>{A}</p>" + "</div>" * 10
    assert extract.parse_page(deep)["article"] == A
    assert extract.parse_page(f"<p>{A}</b></div></p><p>{B}")["article"] == f"{A} {B}"


def plain_buckets(text):
    t = " " + re.sub(r"[^a-zäöüß]+", " ", (text or "")[: language.PREFIX].lower()).strip() + " "
    return [hashed(t[k : k + n]) for n in language.SIZES for k in range(len(t) - n + 1)] if len(t) > 2 else []


def hashed(gram):
    h = 0
    for c in gram:
        h = (h * language.FACTOR + ord(c)) % language.PRIME
    return h % language.BUCKETS


def test_language_model_against_a_plain_one(spark):
    rows = [("the cat sat on the mat and the dog", "en"), ("der hund liegt auf der matte über", "de"), ("and then the dog went to the house", "en"), (None, "en"), ("   ", "de"), ("no label here at all, none", None), ("die katze und der hund im hause", "de")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    counts = {}
    for text, lang in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_buckets(text))
    for lang, own in counts.items():
        want = [math.log((own[b] + 1) / (sum(own.values()) + language.BUCKETS)) for b in range(language.BUCKETS)]
        assert model.tables[lang] == pytest.approx(want, abs=1e-12)
    asked = ["the dog and the cat are here", "der hund ist nicht im hause", "short", None, "", "12345 67890 12345 67890", "x" * 4000, "the the the the the the the"]
    got = [r["l"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "k int, text string").orderBy("k").select(model.detect(F.col("text")).alias("l")).collect()]
    for t, g in zip(asked, got):
        if not t or len(t) < language.LEAST or not re.search("[a-z]", t):
            assert g == ""
        else:
            assert g == max(sorted(model.tables), key=lambda c: sum(model.tables[c][b] for b in plain_buckets(t)))
    assert got[:2] == ["en", "de"]
    empty = language.train(spark.createDataFrame([], "text string, lang string"))
    assert spark.createDataFrame([("a text that is long enough",)], "text string").select(empty.detect(F.col("text"))).first()[0] == ""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy_of_languages(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["language_trained"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    judged = [r for r in rows if len(texts[r["doc_id"]] or "") >= language.LEAST]
    for code in {r["lang"] for r in judged}:
        own = [r["language"] == code for r in judged if r["lang"] == code]
        assert sum(own) / len(own) > 0.99, code
