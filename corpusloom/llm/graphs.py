"""Connected components and bounded cells of LSH buckets: the library's own, and the smallest id of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import cells, components, runs, stars, whole_runs

__all__ = ["cells", "components", "lowest", "runs", "stars", "whole_runs"]

#: Tasks among which the members of one component are spread.
WAYS = 16


def lowest(nodes: DataFrame, roots: DataFrame, node: str, low: str) -> DataFrame:
    """nodes(node, low, ...) with root (node, if it has no link) and the smallest low of its component as component_id.

    Nodes without links are never joined on their root; the members of a component are spread over WAYS tasks, so a
    component of a third of all nodes is no task of its own.
    """
    linked = nodes.join(roots.select(F.col("node").alias(node), "root"), node)
    lows = linked.groupBy("root").agg(F.min(low).alias("component_id")).withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    found = linked.withColumn("_way", F.expr(f"int(pmod(xxhash64({node}), {WAYS}))")).join(lows, ["root", "_way"]).select(node, "root", "component_id")
    out = nodes.join(found, node, "left")
    return out.withColumn("component_id", F.when(F.col("root").isNull(), F.col(low)).otherwise(F.col("component_id"))).withColumn("root", F.coalesce("root", node))
