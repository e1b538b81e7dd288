"""Text, hash and vector functions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_CAP = 4000


def collapse(text: Column, cap: int | None = TEXT_CAP) -> Column:
    """White space runs as one blank, trimmed, and the first cap characters."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.substring(out, 1, cap) if cap else out


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


_WORD = re.compile(r"\w+")


@F.pandas_udf(T.LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit simhash: each distinct token votes with its count by the low half of its MD5; ties are 0. As a signed long.

    A narrow pass without a shuffle; the votes of one text are held at a time.
    """
    known: dict[str, int] = {}
    for texts in batches:
        out = np.zeros(len(texts), dtype=np.uint64)
        for k, text in enumerate(texts):
            counts = Counter(_WORD.findall((text or "").lower()))
            if not counts:
                continue
            if len(known) > 1 << 18:
                known.clear()
            for token in counts:
                if token not in known:
                    known[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
            h = np.fromiter((known[t] for t in counts), dtype=np.uint64, count=len(counts))
            n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.zeros(64)
            for at in range(0, len(h), 65536):
                ones += n[at : at + 65536] @ bits[at : at + 65536]
            out[k] = np.packbits(2 * ones > n.sum(), bitorder="little").view(np.uint64)[0]
        yield pd.Series(out.view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(simhash_: Column, n: int = 8, bits: int = 8) -> Column:
    """The bands of a simhash, lowest first."""
    return F.array(*(F.shiftrightunsigned(simhash_, bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """The default embedder where no model is given: normalised hashed token counts."""
    zero = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(tokens(text), zero, lambda acc, t: F.transform(acc, lambda v, k: v + F.when(k == F.pmod(F.xxhash64(t), F.lit(dim)), 1.0).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(counts, lambda v: v / norm)).otherwise(counts)
