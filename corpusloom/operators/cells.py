"""Similarity joins in bounded pieces: cells of buckets, runs of sorted rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut

#: Edges that one step of a task contracts.
CONTRACT = 1 << 20


def stars(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the graph of pairs (p, q), without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    a, b = at[: len(p)], at[len(p) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        # A root takes the smallest that any of its nodes sees, so chains of roots shorten at each step.
        np.minimum.at(new, low, new.copy())
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[some], nodes[low[some]]


def runs(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the stretches of rows that are equal in all values."""
    n = len(values[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], n)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of rows sorted by keys, cut only where a key changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            same &= values == values[-1]
        last = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        rows = table.num_rows - last
        least_rows = max(least_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cells(keys: DataFrame, key: str, member: str, block: int, alone: bool = False) -> DataFrame:
    """Rows of keys(key, member, ...) dealt to cells (key, i, j) that hold at most about 2 * block rows.

    A key with up to block rows is the cell (0, 0). A larger one is cut into pieces by a hash of the member, and each piece
    goes to its cells with all pieces, so every pair of members meets in one cell: in (p, p) if both are of piece
    p, in (p, q) else. Column piece names a row's own. No row is dropped, but for the rows of keys with a single one, which
    have no pair: without alone they are left out, which pays where rows are wide; with alone only the few large
    keys are joined, and narrow rows go on as they are.
    """
    sizes = keys.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > (block if alone else 1)).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_c"))
    out = keys.join(sizes, key, "left" if alone else "inner").withColumn("_c", F.coalesce("_c", F.lit(1)))
    out = out.withColumn("piece", F.expr(f"int(pmod(xxhash64({member}), _c))"))
    cell = F.expr("transform(sequence(0, _c - 1), q -> struct(least(piece, q) AS i, greatest(piece, q) AS j))")
    return out.withColumn("_cell", F.explode(cell)).select("*", F.col("_cell.i").alias("i"), F.col("_cell.j").alias("j")).drop("_cell", "_c")


def contracted(edges: DataFrame) -> DataFrame:
    """edges(u, v) with each task's share replaced, in steps of bounded size, by stars that join the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= CONTRACT:
                held = [joined()]
                rows = len(held[0][0])
                if rows >= CONTRACT // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined()], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v) of longs: root is the smallest node reachable.

    Tasks contract their own shares; what is left goes through rounds of large-star and small-star steps, each an aggregation (partial first)
    and an equi-join that the adaptive planner can split, with the state checkpointed after each round. Rounds
    grow with the logarithm of the longest chain. Nodes without an edge to another node are not returned.
    """
    e = cut(contracted(edges.where("u <> v")).distinct())
    while True:
        # Done when each node hangs on one root, and no root on another.
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("n").agg(F.sum("down").alias("d"), F.max("up").alias("r")).where("d > 1 OR (d > 0 AND r > 0)").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(contracted(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
