"""Sources around fetched pages: sitemaps, robots rules, conditional requests, and the page table itself.

Fetching over the network is not part of the engine: a fetched table (url, html, ...) is the input, from any reader.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, urls
from ..functions.session import cut

SITEMAP_DEPTH = 3


def seeds(spark: SparkSession, given: list[str]) -> DataFrame:
    """(url, seq) of a list of seed urls."""
    return spark.createDataFrame([(u, k) for k, u in enumerate(given)], "url string, seq long")


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages from any Spark source."""
    return spark.read.format(fmt).load(path)


_SITEMAP = "sitemap array<struct<loc: array<string>>>, url array<struct<loc: array<string>>>, _bad string"


def _locations(nodes: str) -> Column:
    """Trimmed locations of an array of elements, those without any left out."""
    given = F.flatten(F.transform(nodes, lambda x: F.coalesce(x["loc"], F.array().cast("array<string>"))))
    return F.filter(F.transform(given, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sitemap_files(documents: DataFrame) -> DataFrame:
    """(at, children, urls) of each file of documents(url, status, body): the sitemaps and the pages that it lists.

    Files without status 200 and malformed ones, truncated ones too, list nothing; what follows the end of the first element is not read. Of several bodies of a url the smallest counts. Namespaces are not told apart.
    """
    ok = documents.where("status = 200").groupBy(F.col("url").alias("at")).agg(F.min("body").alias("body"))
    read = ok.select("at", F.from_xml("body", _SITEMAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}).alias("x")).where("x._bad IS NULL")
    return read.select("at", _locations("x.sitemap").alias("children"), _locations("x.url").alias("urls"))


def sitemap_urls(roots: DataFrame, documents: DataFrame, depth: int = SITEMAP_DEPTH) -> DataFrame:
    """(root, url) of all pages listed by the sitemaps in roots(url), following index files for depth levels below the root.

    documents(url, status, body) stands for the network. A missing, failed or malformed file lists nothing; what other
    files list stays. Files are parsed once; each level is one join, of the files that no level of the same root had before, so lists that name one another are read once a root.
    """
    files = cut(sitemap_files(documents).where("size(children) > 0 OR size(urls) > 0"))
    edges = files.select("at", F.explode("children").alias("child")).distinct()
    reached = level = roots.select(F.col("url").alias("root"), F.col("url").alias("at")).distinct()
    for _ in range(depth):
        below = level.join(edges, "at").select("root", F.col("child").alias("at")).distinct()
        level = below.join(reached, ["root", "at"], "left_anti")
        reached = reached.unionByName(level)
    listed = reached.join(files, "at").select("root", F.explode("urls").alias("u"))
    return listed.select("root", urls.normalise(F.col("u")).alias("url")).where("url <> ''").distinct()


def sitemap_places(domains: DataFrame, robots: DataFrame) -> DataFrame:
    """(domain, url): the Sitemap lines of each domain's robots(domain, body), else its default place."""
    lines = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    told = domains.select("domain").distinct().join(robots.select("domain", "body"), "domain", "left").select("domain", lines.alias("l"))
    default = F.array(F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml")))
    return told.select("domain", F.explode(F.when(F.size("l") > 0, F.col("l")).otherwise(default)).alias("url")).distinct()


def parse_robots(body: str | None) -> list[tuple[str, list[tuple[bool, str]], float | None]]:
    """(agent, rules in order as (allow, prefix), crawl-delay) of each record of a robots file."""
    records: list = []
    agents: list[str] = []
    open_record = False
    for raw in (body or "").splitlines():
        key, _, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_record:
                agents = []
            open_record = True
            agents.append(value.lower())
            records.append([value.lower(), [], None])
        elif key in ("allow", "disallow", "crawl-delay") and agents:
            open_record = False
            for r in records[-len(agents) :]:
                if key == "crawl-delay":
                    r[2] = float(value) if re.fullmatch(r"\d+(\.\d+)?", value) else r[2]
                elif key == "disallow" and not value:
                    r[1].append((True, ""))
                else:
                    r[1].append((key == "allow", unquote(value)))
    return [tuple(r) for r in records]


def robots_allowed(requests: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """requests with allowed and crawl_delay, from robots(origin, status, body).

    The first rule of the agent's record (else of *) whose path is a prefix decides; none, a missing file or any status but 200 allows.
    """

    @F.pandas_udf("struct<prefixes: array<string>, allow: array<boolean>, delay: double>")
    def compiled(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for body in bodies:
            records = parse_robots(body)
            own = [r for r in records if r[0] == agent.lower()] or [r for r in records if r[0] == "*"]
            rules, delay = (own[0][1], own[0][2]) if own else ([], None)
            rows.append(([p for _, p in rules], [a for a, _ in rules], delay))
        return pd.DataFrame(rows, columns=["prefixes", "allow", "delay"])

    rules = robots.where("status = 200").groupBy("origin").agg(F.min("body").alias("body")).select(F.col("origin").alias("_o"), compiled("body").alias("_r"))
    origin = F.lower(F.regexp_extract(F.col(url), r"^([a-zA-Z]+://[^/?#]*)", 1))
    path = F.url_decode(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.col(url), r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"), r"^$", "/"))
    out = requests.withColumn("_p", path).join(rules, origin == F.col("_o"), "left")
    hits = F.filter(F.arrays_zip("_r.prefixes", "_r.allow"), lambda r: F.startswith(F.col("_p"), r["prefixes"]))
    allowed = F.coalesce(F.get(hits, 0)["allow"], F.lit(True))
    return out.withColumn("allowed", allowed).withColumn("crawl_delay", F.col("_r.delay")).drop("_p", "_o", "_r")


def conditional(requests: DataFrame, pages_: DataFrame | None, url: str = "url") -> DataFrame:
    """requests with header and value of a conditional request: the known etag, else the last modification, else "".

    Column url is the key of both tables. Each request gives one row: of several known rows of a key the one with the greatest etag counts, then
    with the greatest last modification, so one with an etag goes before those without. A null key is not known.
    """
    if pages_ is None:
        return requests.withColumn("header", F.lit("")).withColumn("value", F.lit(""))
    held = F.struct(extract.filled(F.col("etag")).alias("e"), extract.filled(F.col("last_modified")).alias("m"))
    known = pages_.groupBy(F.col(url).alias("_u")).agg(F.max(held).alias("_k")).select("_u", F.col("_k.e").alias("_e"), F.col("_k.m").alias("_m"))
    out = requests.join(known, F.col(url) == F.col("_u"), "left")
    etag, modified = extract.filled(F.col("_e")), extract.filled(F.col("_m"))
    header = F.when(etag != "", "If-None-Match").when(modified != "", "If-Modified-Since").otherwise("")
    return out.withColumn("header", header).withColumn("value", F.when(etag != "", etag).otherwise(modified)).drop("_u", "_e", "_m")


def page_key(canonical: Column, final_url: Column) -> Column:
    """A page's key: its canonical url if it declares one, else where it was found."""
    return extract.filled(canonical, final_url)


def accept(fetched: DataFrame) -> DataFrame:
    """fetched(status, content_type, html) with verdict html, not_modified or rejected; html only where accepted."""
    ok = extract.accepted(F.col("status"), F.col("content_type"))
    return fetched.withColumn("verdict", F.when(ok, "html").when(F.col("status") == 304, "not_modified").otherwise("rejected")).withColumn("html", F.when(ok, F.col("html")))
