"""URL algebra as column functions: normal form, domain, priority score, resolution of links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid")
# Patterns on the lower-cased path and their scores, first match wins.
PATH_SCORES = ((r"/categor|/catalog|/topic", 80), (r"/product|/item|/p/|/article", 60), (r"/blog|/news|/post", 55))
PAGINATION = (r"page=\d+|/page/\d+", 20)
#: The older rule set: fewer kinds of paths, and products at 50.
PATH_SCORES_OLD = ((r"/categor|/catalog", 80), (r"/product|/item|/p/", 50))

_HEAD = r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^[\s\x00-\x20]+|[\s\x1c-\x1f]+$", ""), r"[\t\r\n]", "")


def _path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _HEAD, 3), r";[^/]*$", "")


def domain(url: Column) -> Column:
    """Lower-cased authority, port and user included; "" without one."""
    return F.lower(F.regexp_extract(_clean(url), _HEAD, 2))


def normalise(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Normal form of an http or https URL, else "".

    The authority is lower-cased; trailing slashes, path parameters and the fragment go; of the query's non-blank
    values the first of each key stays, without tracking keys, in the order of keys, encoded afresh.
    """
    u = _clean(url)
    scheme, path = F.lower(F.regexp_extract(u, _HEAD, 1)), F.regexp_replace(_path(u), r"/+$", "")
    path = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    decode = lambda x: F.url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))
    pairs = F.filter(F.split(F.regexp_extract(u, _HEAD, 4), "&"), lambda p: p.rlike("=."))
    pairs = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    # The first of each key: fold, because the place of a pair is not known to filter by value.
    empty = F.expr("cast(array() AS array<struct<k: string, v: string>>)")
    first = F.aggregate(pairs, empty, lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]) | p["k"].isin(*tracking), acc).otherwise(F.concat(acc, F.array(p))))
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(F.array_sort(first), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), F.lower(F.regexp_extract(u, _HEAD, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https"), whole).otherwise("")


def score(url: Column, rules: tuple = PATH_SCORES) -> Column:
    """Priority of a URL by its path; pagination is looked for in the whole URL."""
    path = F.lower(_path(_clean(url)))
    out = F.when(path.isin("", "/"), 100)
    for pattern, points in rules:
        out = out.when(path.rlike(pattern), points)
    return out.when(F.coalesce(url, F.lit("")).rlike(PAGINATION[0]), PAGINATION[1]).otherwise(40)


@F.pandas_udf(T.StringType())
def _join(href: pd.Series, base: pd.Series) -> pd.Series:
    def one(h, b):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return ""

    return pd.Series([one(h, b) for h, b in zip(href, base)])


def resolve(href: Column, base: Column) -> Column:
    """Normal form of a link on a page. Absolute links need no Python."""
    return F.when(href.rlike(r"^(?i)https?://"), normalise(href)).otherwise(normalise(_join(href, base)))
