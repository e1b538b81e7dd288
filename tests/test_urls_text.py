"""URL algebra and text functions against plain definitions."""

import hashlib
import re
from collections import Counter
from urllib.parse import parse_qs, urlencode, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls

CASES = {
    "HTTP://EX.com/A/": "http://ex.com/A", "http://ex.com?b=2&a=1&a=3": "http://ex.com/?a=1&b=2", "http://ex.com/a;p=1?x=": "http://ex.com/a", " https://E.com/é?q=a b&r=%C3%A9~*#f": "https://e.com/é?q=a+b&r=%C3%A9~%2A",
    "http://ex.com/a//?utm_source=x": "http://ex.com/a", "http://ex.com/a?x=1&&y=%zz&=3": "http://ex.com/a?=3&x=1&y=%25zz", "ftp://a/b": "", "mailto:x": "", "//h/p": "", "": "",
    "https://u@H:8080/x/y/?ref=1&page=2#z": "https://u@h:8080/x/y?page=2",
}


def test_normalise_cases(spark):
    got = spark.createDataFrame([(u,) for u in CASES], "u string").select("u", urls.normalise(F.col("u")).alias("n"), urls.normalise(urls.normalise(F.col("u"))).alias("again")).collect()
    assert {r["u"]: r["n"] for r in got} == CASES
    assert all(r["n"] == r["again"] for r in got)


def test_normalise_queries(spark):
    """Random queries against the standard library's parser and encoder."""
    seen = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="abz=&+%2F é~*.-_;", max_size=8), max_size=4))
    def collect(parts):
        seen.append("http://h/p?" + "&".join(parts).replace("#", ""))

    collect()

    def plain(u):
        q = {k: v[0] for k, v in parse_qs(urlsplit(u.strip()).query).items() if k not in urls.TRACKING}
        text = urlencode(sorted(q.items()))
        return "http://h/p" + (f"?{text}" if text else "")

    got = spark.createDataFrame([(u,) for u in seen], "u string").select("u", urls.normalise(F.col("u")).alias("n")).collect()
    for r in got:
        if "�" not in plain(r["u"]) and "%EF%BF%BD" not in plain(r["u"]):
            assert r["n"] == plain(r["u"]), r["u"]


@pytest.mark.parametrize(("url", "points", "old"), [
    ("http://h", 100, 100), ("http://h/", 100, 100), ("http://h/Category/x", 80, 80), ("http://h/topic", 80, 40), ("http://h/p/1", 60, 50), ("http://h/article/1", 60, 40), ("http://h/news?page=2", 55, 20),
    ("http://h/x?page=2", 20, 20), ("http://h/x/page/3", 20, 20), ("http://h/x", 40, 40),
])
def test_score(spark, url, points, old):
    r = spark.createDataFrame([(url,)], "u string").select(urls.score(F.col("u")).alias("a"), urls.score(F.col("u"), urls.PATH_SCORES_OLD).alias("b")).first()
    assert (r["a"], r["b"]) == (points, old)


def test_resolve(spark):
    rows = [("a/b", "http://H/x/y", "http://h/x/a/b"), ("/r?z=1&ref=2", "http://h/x/", "http://h/r?z=1"), ("#f", "http://h/x", "http://h/x"), ("mailto:a@b", "http://h/", ""), ("HTTPS://Other/p/", "http://h/", "https://other/p")]
    for r in spark.createDataFrame(rows, "href string, base string, want string").withColumn("got", urls.resolve(F.col("href"), F.col("base"))).collect():
        assert r["got"] == r["want"]


TEXTS = ["", "a", "Hello hello world", "Straße straße ÜBER_1 x", "one two three four five six seven", "\x1c a   b\n", "a b"]


def simhash(text):
    votes = [0] * 64
    for token, n in Counter(re.findall(r"\w+", text.lower())).items():
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        for b in range(64):
            votes[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_text_functions(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", tx.simhash("t").alias("s"), tx.bands(tx.simhash("t")).alias("b"), tx.collapse(F.col("t")).alias("c"), tx.content_hash(F.col("t")).alias("h"), tx.tokens(F.col("t")).alias("k"), tx.hashed_vector(F.col("t"), 8).alias("v")
    ).collect()
    for r in got:
        want = simhash(r["t"])
        assert r["s"] & (2**64 - 1) == want
        assert r["b"] == [want >> 8 * k & 255 for k in range(8)]
        assert r["c"] == re.sub(r"\s+", " ", r["t"]).strip()
        assert r["h"] == hashlib.sha256(r["t"].encode()).hexdigest()
        assert r["k"] == re.findall(r"\w+", r["t"].lower())
        assert abs(sum(x * x for x in r["v"]) - (1 if r["k"] else 0)) < 1e-9
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(tx.cosine(F.col("a"), F.col("b")).alias("c"), tx.cosine(F.col("a"), F.col("z")).alias("n"), tx.hamming(F.lit(5), F.lit(-1)).alias("h")).first()
    assert abs(row["c"] - 0.5**0.5) < 1e-12 and row["n"] is None and row["h"] == 62
