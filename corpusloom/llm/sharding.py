"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable 64-bit key and the number of shards alone decide a row's shard; there is no ring table. Appending a shard
moves rows only into it, about 1 in n + 1 of them. The key drives a 64-bit linear congruential generator; its
draws give the ever larger shard counts at which the key jumps to the newest shard.

Slots number each shard's rows from 0 without gaps. A shard is cut into pieces of about PIECE_ROWS rows by a hash of key and text, so no task
sorts a whole shard, or all rows of a key that many have: a row's slot is the number of rows in the pieces before plus its rank in its own.

Edge cases: a null key counts as key 0; a null text as no bytes; rows with equal keys share a shard and have
different slots, in the order of size, checksum and text hash (identical rows are interchangeable). Columns named like
the results are replaced. Very long texts are hashed whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkutil import aside, without

_MULTIPLIER = 2862933555777941757
_L0, _L1, _L2 = _MULTIPLIER & 0x3FFFFF, _MULTIPLIER >> 22 & 0x3FFFFF, _MULTIPLIER >> 44
#: Steps of the first fold; a key needs more with a probability that is negligible, and then gets them.
_FIRST = 48
#: Pieces of a shard at least, and rows of one, about, where a shard has more.
LEAST_PIECES, PIECE_ROWS = 256, 100_000


def jump(key: str, shards: int) -> Column:
    """Shard of the long column key among `shards` ones.

    The generator's state is held as limbs of 22, 22 and 20 bits, because a product that wraps is an error in
    Spark's SQL.
    """
    step = f"""(s, x) -> if(s.j >= {shards}, s, {_next('s')})"""
    start = f"named_struct('k0', {key} & 4194303L, 'k1', shiftrightunsigned({key}, 22) & 4194303L, 'k2', shiftrightunsigned({key}, 44), 'b', -1L, 'j', 0L)"
    first = f"aggregate(sequence(1, {min(shards, _FIRST)}), {start}, {step})"
    if shards <= _FIRST:
        return F.expr(f"int(({first}).b)")
    return F.expr(f"int(aggregate(array({first}), 0L, (z, f) -> if(f.j >= {shards}, f.b, aggregate(sequence(1, {shards}), f, {step}).b)))")


def _next(s: str) -> str:
    r0 = f"({s}.k0 * {_L0}L + 1L)"
    r1 = f"({s}.k1 * {_L0}L + {s}.k0 * {_L1}L + shiftrightunsigned({r0}, 22))"
    r2 = f"({s}.k2 * {_L0}L + {s}.k1 * {_L1}L + {s}.k0 * {_L2}L + shiftrightunsigned({r1}, 22))"
    return (
        f"aggregate(array(named_struct('k0', {r0} & 4194303L, 'k1', {r1} & 4194303L, 'k2', {r2} & 1048575L)), {s}, (t, n) -> "
        f"named_struct('k0', n.k0, 'k1', n.k1, 'k2', n.k2, 'b', {s}.j, 'j', "
        f"bigint(double({s}.j + 1L) * (2147483648D / double(shiftleft(n.k2, 11) + shiftrightunsigned(n.k1, 11) + 1L)))))"
    )


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs, restore = aside(without(docs, new), ("_key", "_piece", "_tie", "_rank", "_before", "_n"))
    pieces = pieces or max(LEAST_PIECES, -(-docs.count() // (shards * PIECE_ROWS)))
    keyed = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))
    dealt = keyed.withColumn("shard", jump("_key", shards)).withColumn("_piece", F.expr(f"int(pmod(bigint(conv(substring(md5(concat(string(_key), ':', md5(coalesce({text}, '')))), 1, 8), 16, 10)), {pieces}))"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # shards * pieces rows: one for PIECE_ROWS rows of the input, or less.
    offsets = dealt.groupBy("shard", "_piece").agg(F.count("*").alias("_n")).select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), "law": F.lit("key"),
        "grown_shard": jump("_key", shards + 1), "_tie": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    rank = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", "size", "text_crc32", "_tie"))
    placed = rows.withColumn("_rank", rank.cast("long")).join(offsets, ["shard", "_piece"])
    return restore(placed.withColumn("slot", F.col("_before") + F.col("_rank") - 1).select(*docs.columns, *new))


def jump_sql(key: str, shards: int) -> str:
    """The same in DuckDB's SQL over 128-bit integers, as an expression."""
    step = (
        f"lambda s, x: CASE WHEN s.j >= {shards} THEN s ELSE struct_pack(k := (s.k * {_MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT, b := s.j, "
        f"j := floor((s.j + 1)::DOUBLE * (2147483648::DOUBLE / ((((s.k * {_MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT) >> 33) + 1)::DOUBLE))::HUGEINT) END"
    )
    start = f"struct_pack(k := CASE WHEN {key} < 0 THEN {key}::HUGEINT + 18446744073709551616::HUGEINT ELSE {key}::HUGEINT END, b := (-1)::HUGEINT, j := 0::HUGEINT)"
    return f"list_reduce(list_prepend({start}, list_transform(range({shards}), lambda i: {start})), {step}).b::INTEGER"
