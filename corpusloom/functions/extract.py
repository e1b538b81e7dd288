"""Extraction of pages: title, text, links, meta data, JSON-LD, article, language and entities.

Everything that needs a parser is one Arrow-batched pass over (html, url). Absent strings are "", not null. Models are
pluggable: any function of the given shape can take a default's place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import article as article_
from . import text as tx
from . import urls

# Elements without content of interest; patterns of pages that scripts fill; mime types; selectors' traces.
NOISE = ("script", "style", "nav", "footer", "aside", "header", "noscript")
JS_MARKERS = r"(?i)(data-reactroot|__NEXT_DATA__|ng-version|vue-app|<app-root|window\.__STATE__|__nuxt__|_sveltekit)"
HTML_TYPES = ("text/html", "application/xhtml+xml")
CAPTCHA_MARKERS = r"""(?i)id=["']?(cf-challenge-running|challenge-form)\b|class=["'][^"']*\bg-recaptcha\b|<iframe[^>]*src=["'][^"']*recaptcha|data-hcaptcha-widget-id"""
# Keys of JSON-LD that are flattened.
JSON_LD_KEYS = (
    "name", "headline", "description", "author", "datePublished", "dateModified", "publisher", "url", "image", "price", "priceCurrency",
    "ratingValue", "reviewCount", "articleBody", "breadcrumb", "@type", "itemListElement",
)
FLATTEN_DEPTH = 4
JS_LENGTH, JS_PREFIX = 3000, 5000
LANGUAGE_LEAST, LANGUAGE_PREFIX, ENTITY_PREFIX = 20, 500, 5000

PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("article", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("canonical_href", T.StringType()), T.StructField("json_ld", T.ArrayType(T.StringType())),
])
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))


class _Page(HTMLParser):
    """One pass over a page. Canonical link and JSON-LD are read wherever they stand; text, links and meta only
    outside the noise elements."""

    def __init__(self, noise: tuple[str, ...], keep_noise_links: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.noise, self.keep_noise_links = frozenset(noise), keep_noise_links
        self.stack: list[str] = []
        self.tree, self.at = article_.Tree(), [0]  # block elements, and those open
        self.depth = 0  # open noise elements
        self.title: list[str] | None = None
        self.in_title = self.in_json = self.in_body = self.in_article = False
        self.has_article = False
        self.canonical = ""
        self.texts: list[str] = []
        self.articles: list[str] = []
        self.hrefs: list[str] = []
        self.meta: dict[str, str] = {}
        self.json: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "link" and not self.canonical and given.get("rel") == "canonical":
            self.canonical = given.get("href", "").strip()
        if tag == "meta" and not self.depth and (key := given.get("name") or given.get("property")):
            self.meta[key] = given.get("content", "")
        if tag == "a" and given.get("href") and (not self.depth or self.keep_noise_links):
            self.hrefs.append(given["href"])
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag == "script" and given.get("type") == "application/ld+json":
            self.in_json = True
            self.json.append("")
        if tag == "body":
            self.in_body = True
        if tag in _VOID:
            return
        self.stack.append(tag)
        self.at.append(self.at[-1] if tag in article_.INLINE or self.depth else self.tree.open(tag, self.at[-1], f"{given.get('class', '')} {given.get('id', '')}"))
        if tag in self.noise:
            self.depth += 1
        if tag == "article":
            self.in_article = self.has_article = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("div", "p", "a", "span", "article", "body"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "script":
            self.in_json = False
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self.at.pop()
            if top in self.noise:
                self.depth -= 1
            if top == "article":
                self.in_article = False
            if top == tag:
                break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.in_json:
            self.json[-1] += data
        elif not self.depth and data.strip() and (self.in_body or "head" not in self.stack):
            self.texts.append(data.strip())
            self.tree.texts.append((self.at[-1], data.strip(), "a" in self.stack[-3:]))
            if self.in_article:
                self.articles.append(data.strip())


def parse_page(html: str | None, noise: tuple[str, ...] = NOISE, keep_noise_links: bool = False) -> dict:
    page = _Page(noise, keep_noise_links)
    page.feed(html or "")
    page.close()
    join = lambda parts: re.sub(r"\s+", " ", " ".join(parts)).strip()
    return {
        "title": "".join(page.title or []).strip(), "text": join(page.texts)[: tx.TEXT_CAP], "article": join(page.articles if page.has_article else page.tree.body()), "hrefs": page.hrefs, "meta": page.meta,
        "canonical_href": page.canonical, "json_ld": [x.strip() for x in page.json if x.strip()],
    }


def parsed(html: Column, noise: tuple[str, ...] = NOISE, keep_noise_links: bool = False) -> Column:
    """Struct of a page's parts; pages are parsed in Arrow batches."""

    @F.pandas_udf(PARSED)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(p, noise, keep_noise_links) for p in pages], columns=PARSED.fieldNames())

    return run(html)


def flatten_json_ld(blocks: list[str]) -> dict[str, str]:
    """Whitelisted keys of all JSON-LD blocks, first in pre-order wins; values as JSON text (strings as they are)."""
    found: dict[str, str] = {}

    def visit(value, depth):
        if depth > FLATTEN_DEPTH or not isinstance(value, dict):
            return
        for key, inner in value.items():
            if key in JSON_LD_KEYS and key not in found:
                found[key] = inner if isinstance(inner, str) else json.dumps(inner, ensure_ascii=False)
            for child in inner if isinstance(inner, list) else [inner]:
                visit(child, depth + 1)

    for raw in blocks:
        try:
            data = json.loads(raw)
        except ValueError:
            continue
        for block in data if isinstance(data, list) else [data]:
            visit(block, 0)
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def schema_org(blocks: pd.Series) -> pd.Series:
    return pd.Series([flatten_json_ld([] if b is None else list(b)) for b in blocks])


def author_of(schema: Column) -> Column:
    """Author's name: of an object, of the first of a list, or the string itself."""
    raw = F.coalesce(F.element_at(schema, "author"), F.lit(""))
    named = F.coalesce(F.get_json_object(raw, "$.name"), F.get_json_object(raw, "$[0].name"), F.get_json_object(raw, "$[0]"))
    return F.when(raw.rlike(r"^\s*[\[{]"), F.coalesce(named, F.lit(""))).otherwise(raw)


# Frequent short words of each language: our default detector counts them.
PROFILES = {
    "en": "the of and to in is that for it was on with as be at by this from are or an not have which you but were his they", "de": "der die und das ist nicht ein eine zu den mit von auf für im dem sich des als auch es an werden aus er hat",
    "fr": "le la les de des et est un une dans que qui pour pas sur au avec il par ce plus du ne se en", "es": "el la los las de y que en un una por con no para es su se lo como más del al pero sus",
    "it": "il lo la gli le di e che un una per non con del della sono nel si è da al come più anche", "pt": "o os as de e que um uma para com não do da em por mais dos das se na no ao como foi",
    "nl": "de het een en van is dat op te niet met voor zijn aan er die om ook als naar bij uit maar",
}
# Ranges of characters that decide alone.
SCRIPTS = (("ru", r"[Ѐ-ӿ]"), ("ja", r"[぀-ヿ]"), ("zh", r"[一-鿿]"), ("ar", r"[؀-ۿ]"), ("hi", r"[ऀ-ॿ]"))


def detect_language(text: Column) -> Column:
    """Code of the language of the first 500 characters; "" below 20 characters or without any known word.

    The language with most of its frequent words, ties in the order of PROFILES; a script of its own decides before.
    """
    t = F.coalesce(text, F.lit(""))
    head = F.substring(t, 1, LANGUAGE_PREFIX)
    words = F.split(F.lower(head), r"[^\p{L}]+")
    known = lambda listed: lambda w: w.isin(*listed.split())
    hits = [F.struct(F.size(F.filter(words, known(p))).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (code, p) in enumerate(PROFILES.items())]
    best = F.greatest(*hits)
    out = F.when(F.char_length(t) < LANGUAGE_LEAST, "")
    for code, pattern in SCRIPTS:
        out = out.when(F.regexp_count(head, F.lit(pattern)) * 3 >= F.char_length(head), code)
    return out.when(best["n"] > 0, best["code"]).otherwise("")


def in_scope(language: Column, targets: tuple[str, ...] | None) -> Column:
    return language.isin(*targets) if targets else F.lit(True)


ENTITY_PATTERNS = (
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b"),
    ("MONEY", r"[$€£]\s?\d+(?:[.,]\d+)*|\b\d+(?:[.,]\d+)* (?:dollars|euros|pounds|USD|EUR|GBP)\b"),
    ("ORG", r"\b(?:[A-Z][\w&-]+ )+(?:Inc|Ltd|Corp|GmbH|AG|LLC|University|Institute|Bank)\b"),
    ("PERSON", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]\w+(?: [A-Z]\w+)?"),
)


def entities(text: Column) -> Column:
    """Map of label to ordered distinct mentions in the first 5000 characters; labels without any are left out. Default: patterns."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, ENTITY_PREFIX)
    found = F.array(*(F.struct(F.lit(label), F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(p), F.lit(0)), lambda m: F.trim(m)))) for label, p in ENTITY_PATTERNS))
    return F.map_from_entries(F.filter(found, lambda e: F.size(e["col2"]) > 0))


def needs_js(html: Column) -> Column:
    """Short pages, and those with a framework's marker near the start."""
    h = F.coalesce(html, F.lit(""))
    return (F.char_length(h) < JS_LENGTH) | F.substring(h, 1, JS_PREFIX).rlike(JS_MARKERS)


def captcha(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(CAPTCHA_MARKERS)


def accepted(status: Column, content_type: Column) -> Column:
    """200 and an HTML type."""
    return (status == 200) & F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))).isin(*HTML_TYPES)


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ""."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def extract(
    pages: DataFrame, html: str = "html", url: str = "url", keep_noise_links: bool = False, article: Callable[[Column, Column], Column] | None = None,
    language: Callable[[Column], Column] | None = None, ner: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """pages with column content: title, text, article, author, date, language, json_ld, schema_org, entities, links, meta, canonical.

    article(html, url) gives a body; the default is the text in <article>, or else that of the element that scores best. language and ner take the article or else the text.
    """
    page = pages.withColumn("_p", parsed(F.col(html), keep_noise_links=keep_noise_links))
    page = page.withColumn("_s", schema_org("_p.json_ld")).withColumn("_a", F.coalesce(article(F.col(html), F.col(url)), F.lit("")) if article else F.col("_p.article"))
    body = filled(F.col("_a"), F.col("_p.text"))
    links = F.array_distinct(F.filter(F.transform(F.arrays_zip("_p.hrefs", "_j"), lambda x: urls.normalise(x["_j"])), lambda x: x != ""))
    joined = page.withColumn("_j", _resolve_all("_p.hrefs", url)).withColumn("_c", _resolve_all(F.array("_p.canonical_href"), url)[0])
    canonical = F.nullif(urls.normalise(F.when(F.col("_p.canonical_href") != "", F.col("_c"))), F.lit(""))
    content = F.struct(
        filled(F.col("_p.title"), F.element_at("_s", "headline")).alias("title"), F.col("_p.text").alias("text"), F.col("_a").alias("article"), author_of(F.col("_s")).alias("author"),
        filled(F.element_at("_s", "datePublished")).alias("date"), (language or detect_language)(body).alias("language"), F.col("_p.json_ld").alias("json_ld"), F.col("_s").alias("schema_org"),
        (ner or entities)(body).alias("entities"), links.alias("links"), F.col("_p.meta").alias("meta"), canonical.alias("canonical"),
    )
    return joined.withColumn("content", content).drop("_p", "_s", "_a", "_j", "_c")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolve_all(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(href, page):
        try:
            return urljoin(page or "", href or "")
        except ValueError:
            return ""

    return pd.Series([[one(h, b) for h in ([] if hs is None else hs)] for hs, b in zip(hrefs, base)])
