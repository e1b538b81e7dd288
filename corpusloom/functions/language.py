"""Language of a text by character n-gram models that are trained from labelled texts.

The n-grams of a text's first characters (lower case, everything but letters as one blank) are counted by language in BUCKETS buckets of a hash, in one
aggregation: a model is a table of languages times buckets, however much text it is trained on. A text's language is the one under whose model its n-grams
are likeliest (one is added to each count); scoring is a column expression without a shuffle or Python.

Edge cases: null and short texts (below LEAST characters), and those without letters, have no language (""). Rows without a label train nothing; labels
are taken as they are, whatever their number of rows: there is no prior. Equal scores go to the first label in order. A model without any row gives "".
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Of the hash of an n-gram: h = (h * FACTOR + code point) % PRIME, character by character.
FACTOR, PRIME = 65599, 1048573
SIZES = (2, 3, 4)
LEAST, PREFIX = 20, 500


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def buckets(text: Column, sizes: tuple[int, ...] = SIZES, prefix: int = PREFIX) -> Column:
    """Array of the buckets of a text's n-grams, repeats included."""
    clean = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, prefix)), r"[^\p{L}]+", " ")), F.lit(" "))
    codes = F.transform(F.split(clean, ""), F.ascii)
    none = F.array().cast("array<int>")

    def grams(c: Column, size: int) -> Column:
        def hashed(k: Column) -> Column:
            h = F.lit(0).cast("long")
            for d in range(size):
                h = (h * FACTOR + F.get(c, k + d)) % PRIME
            return (h % BUCKETS).cast("int")

        return F.when(F.size(c) >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - size, F.lit(0))), hashed)).otherwise(none)

    # Without a letter there are two blanks.
    return _let(codes, lambda c: F.when(F.size(c) > 2, F.concat(*(grams(c, size) for size in sizes))).otherwise(none))


@dataclass
class Model:
    """Log-likelihoods of the buckets by language."""

    tables: dict[str, list[float]]
    sizes: tuple[int, ...] = SIZES

    def scores(self, text: Column) -> Column:
        """Array of (score, language), of each language of the model. All are added up in one pass over the n-grams."""
        held = [F.split(F.lit(",".join(f"{v:.17g}" for v in table)), ",").cast("array<double>") for table in self.tables.values()]  # folded to constants
        names = [f"s{k}" for k in range(len(held))]
        start = F.struct(*(F.lit(0.0).alias(n) for n in names), F.lit(0).alias("z"))
        total = F.aggregate(buckets(text, self.sizes), start, lambda s, b: F.struct(*((s[n] + F.element_at(t, b + 1)).alias(n) for n, t in zip(names, held)), s["z"].alias("z")))
        return _let(total, lambda t: F.array(*(F.struct(t[n].alias("score"), F.lit(code).alias("language")) for n, code in zip(names, self.tables))))

    def detect(self, text: Column) -> Column:
        """The language of a text. Has the shape that extract() takes as its language."""
        if not self.tables:
            return F.lit("")
        best = F.array_sort(self.scores(text), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["language"] < b["language"], -1).otherwise(1))
        t = F.coalesce(text, F.lit(""))
        lettered = F.substring(t, 1, PREFIX).rlike(r"\p{L}")
        return F.when((F.char_length(t) >= LEAST) & lettered, F.coalesce(F.get(best, F.lit(0))["language"], F.lit(""))).otherwise("")


def train(labelled: DataFrame, text: str = "text", label: str = "lang", sizes: tuple[int, ...] = SIZES) -> Model:
    """The model of labelled texts: one aggregation, with partial sums, over their n-grams."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.explode(buckets(F.col(text), sizes)).alias("b"))
    counts: dict[str, list[int]] = {}
    for r in rows.groupBy("label", "b").agg(F.count("*").alias("n")).collect():  # languages times BUCKETS at most
        counts.setdefault(r["label"], [0] * BUCKETS)[r["b"]] = r["n"]
    return Model({code: [math.log((c + 1) / (sum(own) + BUCKETS)) for c in own] for code, own in sorted(counts.items())}, sizes)


def detector(model: Model) -> Callable[[Column], Column]:
    return model.detect
