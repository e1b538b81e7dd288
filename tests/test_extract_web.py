"""Extraction, robots, sitemaps and requests on small inputs."""

import json

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import extract
from corpusloom.plans import catalogue
from corpusloom.sources import web

PAGE = """<html><head><title> A &amp; B </title><meta name="k" content="1"><meta property="k" content="2"><meta name="e">
<link rel="canonical" href=""><link rel="canonical" href="/c/?ref=1"><script type="application/ld+json">{"@type": "Article", "headline": "H", "author": {"name": "Ann"}, "x": {"headline": "inner", "price": 3}}</script>
<script type="application/ld+json">not json</script></head><body><nav><a href="/nav">n</a></nav><article><p>First  text here.</p><a href="l/1">one</a><a href="#top">t</a><a href="l/1#x">again</a><a href="mailto:x">m</a></article>
<noscript>no</noscript><footer>foot</footer></body></html>"""


def content(spark, html, **how):
    return extract.extract(spark.createDataFrame([(html, "http://h/d/p")], "html string, url string"), **how).first()["content"]


def test_page(spark):
    c = content(spark, PAGE)
    assert (c["title"], c["text"], c["article"]) == ("A & B", "First text here. one t again m", "First text here. one t again m")
    assert c["canonical"] == "http://h/c" and c["links"] == ["http://h/d/l/1", "http://h/d/p"] and c["meta"] == {"k": "2", "e": ""}
    assert c["author"] == "Ann" and c["schema_org"]["headline"] == "H" and c["schema_org"]["price"] == "3" and len(c["json_ld"]) == 2
    assert content(spark, PAGE, keep_noise_links=True)["links"][0] == "http://h/nav"
    empty = content(spark, None)
    assert (empty["title"], empty["text"], empty["links"], empty["canonical"], empty["language"]) == ("", "", [], None, "")
    assert content(spark, '<script type="application/ld+json">{"headline": "T"}</script>')["title"] == "T"
    assert content(spark, PAGE, article=lambda h, u: F.lit("Body"), language=lambda t: F.lit("xx"))["language"] == "xx"


def test_json_ld():
    flat = extract.flatten_json_ld
    deep = {"name": 0}
    for k in range(6):
        deep = {"in": deep, "name": k} if k in (0, 5) else {"in": deep}
    assert flat([json.dumps(deep)]) == {"name": "5"}
    assert flat(['[{"name": "a"}, {"name": "b", "url": "u"}]', "{", "3"]) == {"name": "a", "url": "u"}
    assert flat(['{"@graph": [{"headline": "g"}]}']) == {"headline": "g"}


def test_author_language_entities(spark):
    rows = [("Ann",), ('{"name": "Bo"}',), ('[{"name": "Cy"}, {"name": "D"}]',), ('["Di"]',), ("{}",)]
    got = spark.createDataFrame(rows, "a string").select(extract.author_of(F.create_map(F.lit("author"), F.col("a"))).alias("x")).collect()
    assert [r["x"] for r in got] == ["Ann", "Bo", "Cy", "Di", ""]
    texts = ["a" * 19, "the cat is in the house and it was good", "der Hund ist nicht in dem Haus und das ist gut", "le chat est dans la maison et il est bon", "el gato que está en la casa y los perros", "это просто длинный русский текст для теста", "zzzz qqqq wwww rrrr tttt"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(extract.detect_language(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in got] == ["", "en", "de", "fr", "es", "ru", ""]
    e = spark.createDataFrame([("On 2024-01-05 Dr. Ann Lee paid $5.50 to Big Data Inc, and $5.50 again.",)], "t string").select(extract.entities(F.col("t")).alias("e")).first()["e"]
    assert e == {"DATE": ["2024-01-05"], "MONEY": ["$5.50"], "ORG": ["Big Data Inc"], "PERSON": ["Dr. Ann Lee"]}
    assert spark.range(1).select(extract.in_scope(F.lit(""), ("en",)).alias("a"), extract.in_scope(F.lit(""), None).alias("b")).first() == (False, True)


def test_robots(spark):
    body = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nUser-agent: other\nDisallow: /a%20b\nAllow: /x/ok\nDisallow: /x\nCrawl-delay: 3\n"
    robots = spark.createDataFrame([("http://h", 200, body), ("http://gone", 404, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    asked = spark.createDataFrame([(u,) for u in ("http://h/", "http://h/x/ok/1", "http://h/x/no", "http://h/a b/c", "http://gone/x", "http://none/")], "url string")
    got = {r["url"]: r["allowed"] for r in web.robots_allowed(asked, robots).collect()}
    assert got == {"http://h/": True, "http://h/x/ok/1": True, "http://h/x/no": False, "http://h/a b/c": False, "http://gone/x": True, "http://none/": True}
    assert not any(r["allowed"] for r in web.robots_allowed(asked.where("url LIKE 'http://h/%'"), robots, agent="bad").collect())


def test_sitemaps(spark):
    page = lambda *u: "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    files = [("r", 200, index("a", "b", "c", "d1")), ("a", 200, page("http://h/1/", "http://h/2")), ("b", 200, "<urlset><url><loc>http://h/3"), ("c", 500, page("http://h/4"))]
    files += [("d1", 200, index("d2")), ("d2", 200, index("d3")), ("d3", 200, index("d4") .replace("</sitemapindex>", "<url><loc>http://h/5</loc></url></sitemapindex>")), ("d4", 200, page("http://h/6"))]
    got = web.sitemap_urls(spark.createDataFrame([("r",)], "url string"), spark.createDataFrame(files, "url string, status int, body string"))
    assert {r["url"] for r in got.collect()} == {"http://h/1", "http://h/2", "http://h/5"}
    odd = [
        ("a", 200, "<?xml version='1.0' encoding='UTF-8'?>\n<!-- c --><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9' xmlns:i='http://i'><url><loc>\n http://h/1?a=1&amp;b=2 \n</loc><i:image><i:loc>http://h/no</i:loc></i:image><lastmod>2024</lastmod></url><url><lastmod>1</lastmod></url><url><loc/></url></urlset>\n"),
        ("b", 200, "<urlset><url><loc>http://h/2</loc></url><url><loc>http://h/3</loc></url>"), ("c", 200, "<urlset><url><loc>http://h/4</loc></url></urlse>"), ("d", 200, None), ("e", 200, ""), ("f", 200, "no xml"), ("g", 404, page("http://h/5")),
        ("h", 200, "<urlset><url><loc><![CDATA[http://h/6?x=1&y=2]]></loc></url></urlset>"), ("i", 200, "<urlset><url><loc>http://h/7 & more</loc></url></urlset>"), ("j", 200, page("http://h/b")), ("j", 200, page("http://h/a")), ("k", 200, "<urlset/>"),
        ("l", 200, index("l", "m")), ("m", 200, index("l", "m", "j")), ("n", 200, "<urlset><url><loc>http://h/8</loc></url></urlset><urlset>"),
    ]
    files = spark.createDataFrame(odd, "url string, status int, body string")
    listed = {r["at"]: (sorted(r["children"] or []), sorted(r["urls"] or [])) for r in web.sitemap_files(files).collect()}
    assert {k: v for k, v in listed.items() if v != ([], [])} == {"a": ([], ["http://h/1?a=1&b=2"]), "h": ([], ["http://h/6?x=1&y=2"]), "j": ([], ["http://h/a"]), "l": (["l", "m"], []), "m": (["j", "l", "m"], []), "n": ([], ["http://h/8"])}
    got = web.sitemap_urls(spark.createDataFrame([("l",), ("a",), ("b",)], "url string"), files)
    assert sorted(map(tuple, got.collect())) == [("a", "http://h/1?a=1&b=2"), ("l", "http://h/a")]
    places = web.sitemap_places(spark.createDataFrame([("h",), ("k",)], "domain string"), spark.createDataFrame([("h", "x\nSitemap: http://h/s.xml\nsitemap:http://h/t.xml")], "domain string, body string"))
    assert {(r[0], r[1]) for r in places.collect()} == {("h", "http://h/s.xml"), ("h", "http://h/t.xml"), ("k", "https://k/sitemap.xml")}


def test_predicates(spark):
    rows = [("x" * 3000, False), ("x" * 2999, True), ("<app-root>" + "x" * 3000, True), ("x" * 5000 + "vue-app", False), (None, True)]
    for r in spark.createDataFrame(rows, "h string, want boolean").withColumn("got", extract.needs_js(F.col("h"))).collect():
        assert r["got"] == r["want"]
    assert spark.range(1).select(extract.captcha(F.lit("<div class='a g-recaptcha'>")).alias("c")).first()["c"]
    known = spark.createDataFrame([("a", "E", "M"), ("b", "", "M"), ("c", None, None)], "url string, etag string, last_modified string")
    got = web.conditional(spark.createDataFrame([(u,) for u in "abcd"], "url string"), known)
    assert {r["url"]: (r["header"], r["value"]) for r in got.collect()} == {"a": ("If-None-Match", "E"), "b": ("If-Modified-Since", "M"), "c": ("", ""), "d": ("", "")}


def test_conditional_repeats(spark, tmp_path):
    """One row a request, whatever repeats: known urls, requests, null keys, and urls that several pages of the query's table share."""
    known = spark.createDataFrame([("a", "", "M2"), ("a", "E1", "M1"), ("a", "E1", "M1"), ("b", None, "M1"), ("b", "", "M2"), (None, "E", "M")], "url string, etag string, last_modified string")
    got = web.conditional(spark.createDataFrame([(u,) for u in ("a", "a", "b", "c", None)], "url string"), known)
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(url=u, header=h, value=v) for u, h, v in [("a", "If-None-Match", "E1")] * 2 + [("b", "If-Modified-Since", "M2"), ("c", "", ""), (None, "", "")]]))
    spark.createDataFrame([(k, "http://a.example/" + "xy"[k % 2]) for k in range(-6, 12)] + [(3, None), (None, "http://a.example/x")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(catalogue.ORACLE_SQL["conditional_request"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert len(want) == 20 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in catalogue.QUERIES["conditional_request"](spark, str(tmp_path)).collect())
