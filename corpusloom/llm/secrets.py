"""Secret scans, in DataFrame functions only.

Three plain rules find known forms: assignments, access keys and long hexadecimal strings. Beside them two character
Markov models, of random strings and of ordinary identifiers, are trained from labelled samples; a token whose log-likelihood
ratio says random is a span of kind `random`, unless it overlaps a span of the rules.

A model is a table of log P(character | character before), with one added to each count; training is one aggregation over
pairs of characters. The ratio table (alphabet squared, however large the samples) is a constant of the scan, which is
one narrow pass without a shuffle. Spans count code points, with exclusive ends.

Places are running sums of the matches' lengths, taken in parts of about the root of their number: a text with n matches costs n ** 1.5 small steps.

Edge cases: a null or empty text has no spans; texts of any length are read whole; rows keep their multiplicity, and equal texts have equal spans; an
empty table gives an empty result, and trains models of no samples. A class without samples has the uniform model. Spans with one start come in the order of KINDS; a ratio that
equals the threshold is a span. Columns named base or spans are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparkutil import aside, without

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: For these two a run's match is the run, so shorter ones may be skipped by the pattern itself.
_LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge: maximal runs of these characters, whatever stands beside them, with the padding at their end.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Nats by which the random model has to be likelier: for the token, and for each character.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.35
SAMPLES = 4000


def samples(spark: SparkSession, ordinary: DataFrame, text: str = "text", rows: int = SAMPLES) -> DataFrame:
    """Labelled samples (sample, label): 1 random, 0 ordinary.

    Random strings are digests of a counter in three alphabets. Ordinary ones are words of a text table, alone and
    joined as identifiers are, and numbers, plain and with dashes. rows words at most are taken, the first by a hash.
    """
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    counter = spark.range(rows)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = counter.select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(base64, 1, 40), F.substring(F.translate(F.upper(base64), "+/", "27"), 1, 20))).alias("sample"))
    found = ordinary.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(rows)
    cased = F.initcap("w")
    number = F.pmod(F.xxhash64("w"), F.lit(10**16)).cast("string")
    dashed = F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2), F.substring(number, 9, 2))
    words = found.select(F.explode(F.array("w", "w", F.lower("w"), F.upper("w"), F.concat(F.lower("w"), F.lit("_"), F.lower("w")), F.concat(F.lower("w"), F.lit("-"), F.lower("w")), F.concat(F.lit("get"), cased, cased), F.concat(F.lower("w"), F.lit("/"), F.lower("w")), number, dashed)).alias("sample"))
    return random.withColumn("label", F.lit(1)).unionByName(words.withColumn("label", F.lit(0)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each pair of characters, row by row; row 0 is the start."""
    size = len(ALPHABET)
    pairs = labelled.where("sample IS NOT NULL AND label IN (0, 1)").select("label", F.explode(F.expr("transform(sequence(1, length(sample)), k -> struct(if(k = 1, '', substring(sample, k - 1, 1)) AS a, substring(sample, k, 1) AS b))")).alias("p"))
    counts = pairs.groupBy("label", F.when(F.col("p.a") == "", 0).otherwise(F.instr(F.lit(ALPHABET), F.col("p.a"))).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b")).count()
    n = [[[1.0] * size for _ in range(size + 1)] for _ in range(2)]
    for r in counts.where("b > 0").collect():  # at most twice the alphabet squared
        n[r["label"]][r["a"]][r["b"] - 1] += r["count"]
    return [math.log(n[1][a][b] / sum(n[1][a])) - math.log(n[0][a][b] / sum(n[0][a])) for a in range(size + 1) for b in range(size)]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ratio(token: str, table: str) -> str:
    size = len(ALPHABET)
    at = lambda k: f"instr('{ALPHABET}', substring({token}, {k}, 1))"
    return f"aggregate(sequence(1, length({token})), 0D, (s, k) -> s + element_at({table}, if(k = 1, 0, {at('k - 1')}) * {size} + {at('k')}))"


_SPAN = "start: int, kind: int, end: int"


def _none(fields: str) -> str:
    return f"cast(array() AS array<struct<{fields}>>)"


def _running(given: str, zero: str, step: str, out: str, fields: str) -> str:
    """SQL of the array of `out` of each element x of an array, with `at` the state before it: zero, then step by step.

    The array is cut in parts: one pass takes the state at each part's start, a second the elements within, so what is appended to stays short.
    """
    part = "cast(ceil(sqrt(size(z))) AS int)"
    parts = f"transform(sequence(0, cast((size(z) - 1) div {part} AS int)), b -> slice(z, b * {part} + 1, {part}))"
    starts = f"slice(aggregate(c, array({zero}), (s, own) -> concat(s, array(aggregate(own, element_at(s, -1), (at, x) -> {step})))), 1, size(c))"
    inner = f"aggregate(own, struct(o AS at, {_none(fields)} AS found), (t, x) -> transform(array(t.at), at -> struct({step} AS at, concat(t.found, array({out})) AS found))[0]).found"
    return f"transform(array({given}), z -> if(size(z) = 0, {_none(fields)}, transform(array({parts}), c -> flatten(zip_with(c, {starts}, (own, o) -> {inner})))[0]))[0]"


def _spans(text: str, pattern: str, kind: int, good: str) -> str:
    """SQL of the array of spans (start, kind, end) of a pattern's matches m that are good.

    Matches and the pieces between them give the places.
    """
    p = _quoted(pattern)
    pairs = f"zip_with(m, slice(split({text}, {p}, -1), 1, size(m)), (y, g) -> struct(length(g) AS g, length(y) AS n, {good.format(m='y')} AS ok))"
    placed = _running(pairs, "0", "at + x.g + x.n", "struct(at + x.g AS start, x.n AS n, x.ok AS ok)", "start: int, n: int, ok: boolean")
    kept = f"transform(filter({placed}, x -> x.ok), x -> struct(x.start AS start, {kind} AS kind, x.start + x.n AS end))"
    return f"transform(array(regexp_extract_all({text}, {p}, 0)), m -> if(exists(m, y -> {good.format(m='y')}), {kept}, {_none(_SPAN)}))[0]"


def _beside(base: str, more: str) -> str:
    """SQL of base and those of the spans more that overlap none of it, sorted.

    In the order of starts a span overlaps one before it if the greatest end so far is beyond its start, and one after it if the next start is before its end.
    """
    ruled = "x.kind < 3"
    before = _running(f"array_sort(concat({base}, {more}))", "0", f"if({ruled}, greatest(at, x.end), at)", "struct(x.start AS start, x.kind AS kind, x.end AS end, at AS low)", f"{_SPAN}, low: int")
    both = _running(f"reverse({before})", "2147483647", f"if({ruled}, x.start, at)", "struct(x.start AS start, x.kind AS kind, x.end AS end, x.low AS low, at AS high)", f"{_SPAN}, low: int, high: int")
    kept = f"transform(filter({both}, x -> {ruled} OR (x.low <= x.start AND x.high >= x.end)), x -> struct(x.start AS start, x.kind AS kind, x.end AS end))"
    return f"if(size({base}) = 0 OR size({more}) = 0, array_sort(concat({base}, {more})), array_sort({kept}))"


def scan(docs: DataFrame, ratios: list[float], text: str = "text", total: float = LEAST_TOTAL, each: float = LEAST_EACH) -> DataFrame:
    """docs with base and spans: sorted arrays of (start, kind, end), kind an index of KINDS."""
    docs, restore = aside(without(docs, ("base", "spans")), ("_text",))
    table = "cast(split('" + ",".join(f"{x:.9g}" for x in ratios) + "', ',') AS array<double>)"
    assign = _spans("_text", ASSIGN, 0, f"length(regexp_extract({{m}}, {_quoted(ASSIGN)}, 2)) >= {LEAST['assign']}")
    access, hexes = (_spans("_text", _LONG[k], KINDS.index(k), f"length({{m}}) >= {LEAST[k]}") for k in ("access", "hex"))
    ratio = _ratio("{m}", table)
    random = _spans("_text", TOKEN, 3, f"{ratio} >= greatest({total}D, {each}D * length({{m}}))")
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("base", F.array_sort(F.expr(f"concat({assign}, {access}, {hexes})")))
    out = out.withColumn("spans", F.expr(f"transform(array({random}), r -> {_beside('base', 'r')})[0]"))
    return restore(out.drop("_text"))


def count(kind: str, spans: str = "base") -> Column:
    return F.expr(f"bigint(size(filter({spans}, s -> s.kind = {KINDS.index(kind)})))")


def listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.kind + 1), ':', s.start, ':', s.end)), ',')")


def redacted(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark. For use on a result of scan."""
    ends = _running(spans, "0", "greatest(at, x.end)", "struct(x.start AS start, at AS low)", "start: int, low: int")
    pieces = f"transform(filter({ends}, x -> x.start >= x.low), x -> concat(substring({text}, x.low + 1, x.start - x.low), '{mark}'))"
    return F.expr(f"if(size({spans}) > 0, concat(array_join({pieces}, ''), substring({text}, array_max(transform({spans}, x -> x.end)) + 1)), {text})")
