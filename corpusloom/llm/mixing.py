"""Mixing sources to target weights by systematic sampling.

Each document's expected number of copies is its source's target over its source's size. Within a source the expected
copies are summed along an order of the documents, one random offset is added, and a document is emitted once for
each integer that its stretch of the sum crosses. Documents are ordered by size class (8 classes to an octave), so each
class of sizes is represented in proportion and the words taken come close to the target.

Targets share the total of all sizes by weight; a target stops at `most` times its source's size and the excess is shared
again by weight, until none is above. That fixed point is found in closed form over the sorted ratios of caps to weights.

A source is cut into pieces by size class and a hash of id and text: a row's place in its source is the number of rows in
the pieces before plus its rank in its own piece, so a source with a third of all rows is no task of its own. Only the
table of sources (one row each) is sorted as a whole.

Edge cases: a null text has size 0, as has an empty one; a null source is a source, the last; sources of size 0 have
target 0; with the same seed reruns agree (ties are identical rows but for columns beside id, size and text). An empty
table gives an empty result. Very long texts are counted whole; rows that repeat an id are rows of their own. Columns named like the results are replaced by planned, and kept by mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkutil import aside, without

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Pieces of a source's size class at least, and rows of one, about, if all rows were of one source and class.
LEAST_PIECES, PIECE_ROWS = 64, 100_000
WORD = r"[^\x20\x09-\x0D]+"
_OWN = ["_size", "_class", "_piece", "_rank", "_before", "_source_size", "_target", "_tie", "_n", "_s", "_plan_source", "_plan_class", "_plan_piece"]


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, _source_size) with _target."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    given = F.array(*map(F.lit, weights))
    weighted = sizes.withColumn("_w", F.element_at(given, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    # Capped first are those whose cap over weight is smallest. shared: the level if those before, alone, are capped.
    by_ratio = Window.orderBy((most * F.col("_source_size") / F.col("_w")).asc(), F.col(source).asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = weighted.withColumns({
        "_left": F.sum("_source_size").over(every) - most * F.coalesce(F.sum("_source_size").over(before), F.lit(0)),
        "_weight": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    })
    fits = F.col("_left") * F.col("_w") <= most * F.col("_source_size") * F.col("_weight")
    level = levels.withColumn("_fit", fits)
    pick = lambda c: F.min(F.when(F.col("_fit"), F.struct(F.col("_place").alias("p"), F.col(c).alias("v")))).over(every)["v"]
    placed = level.withColumn("_place", F.row_number().over(by_ratio))
    placed = placed.withColumns({"_l": pick("_left"), "_ws": pick("_weight"), "_at": pick("_place")})
    share = F.col("_w") * F.col("_l") / F.col("_ws")
    return placed.select(source, "_source_size", F.when(F.col("_place") < F.col("_at"), (most * F.col("_source_size")).cast("double")).otherwise(share.cast("double")).alias("_target"))


def planned(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, pieces: int | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (times that the mix emits the row)."""
    new = ["size", "source_size", "target", "copies"]
    docs, restore = aside(without(docs, new), _OWN)
    pieces = pieces or max(LEAST_PIECES, -(-docs.count() // PIECE_ROWS))
    sized = docs.withColumn("_size", words_of(text))
    # Number of leading bits and the next three: the upper limit of a class is an eighth above the lower.
    bits = F.when(F.col("_size") > 0, F.length(F.bin("_size"))).otherwise(0)
    classed = sized.withColumn("_class", F.when(F.col("_size") < 8, F.col("_size").cast("int")).otherwise(bits * 8 + F.expr("int(shiftright(_size, int(greatest(length(bin(_size)) - 4, 0))) & 7)")))
    dealt = classed.withColumn("_piece", F.expr(f"int(pmod(bigint(conv(substring(md5(concat('{seed}:', coalesce(string({doc_id}), ''), ':', md5(coalesce({text}, '')))), 1, 8), 16, 10)), {pieces}))"))
    # Both uses below read both columns (the conditions always hold), so their exchange is one and the words of all texts are counted once here
    # and once for the rows.
    counts = dealt.groupBy(source, "_class", "_piece").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s")).where("_n > 0 AND _s >= 0")
    before = Window.partitionBy(source).orderBy("_class", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(source, "_class", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    goals = targets(counts.groupBy(source).agg(F.sum("_s").alias("_source_size")), source, weights, most)
    # The plan of a piece, one row each; nulls of source compare equal.
    plan = offsets.alias("o").join(goals.alias("g"), F.col(f"o.{source}").eqNullSafe(F.col(f"g.{source}"))).select(*(F.col(f"o.{c}") for c in offsets.columns), "_source_size", "_target")
    plan = plan.select(F.col(source).alias("_plan_source"), F.col("_class").alias("_plan_class"), F.col("_piece").alias("_plan_piece"), "_before", "_source_size", "_target")
    rank = F.row_number().over(Window.partitionBy(source, "_class", "_piece").orderBy("_size", doc_id, "_tie"))
    ranked = dealt.withColumn("_tie", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("_rank", rank.cast("long"))
    rows = ranked.join(plan, ranked[source].eqNullSafe(F.col("_plan_source")) & (F.col("_class") == F.col("_plan_class")) & (F.col("_piece") == F.col("_plan_piece")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    # 16 bits of offset, so that sums with whole rates are exact.
    offset = F.expr(f"conv(substring(md5(concat('{seed}:', coalesce({source}, ''))), 1, 4), 16, 10) / 65536D")
    place = F.col("_before") + F.col("_rank")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return restore(rows.select(*docs.columns, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.cast("long").alias("copies")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: docs' rows, each as often as planned, with docs' columns."""
    docs, restore = aside(docs, ("size", "source_size", "target", "copies"))
    rows = planned(docs, **how)
    return restore(rows.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns))
