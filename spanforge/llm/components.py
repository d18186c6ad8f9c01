"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations over the edges. All nodes end in a star around the smallest node of their component. A node with very many neighbours is no single task's burden: its neighbours aren't gathered, only their minimum is, by partial aggregates. It is cut from its plan before it is joined back to the edges, so that both sides of that join are plain shuffles, which Spark splits where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges: (u, v) with u > v. Large: each node's larger neighbours are linked to the least of its neighbours and itself; small: its smaller neighbours and itself are."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        # only larger neighbours are linked anew: the edges themselves, seen from their smaller end
        seen = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
        out = seen.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = common.cut(edges.groupBy("u").agg(F.min("v").alias("m")), parts)
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge; component is the smallest node that can be reached.

    edges: two long columns a and b, in any order and number of times; loops are left out. The number of rounds grows with the logarithm of the longest chain, so 60 are never reached in practice; it raises if they are.
    """
    a, b = edges.columns[:2]
    now = common.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct())
    size = now.count()
    if not size:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    parts = common.parts(size)
    before = None
    for _ in range(most_rounds):
        now = common.cut(_star(_star(now, True, parts), False, parts), parts)
        # a star around each minimum: nothing left that is both above one node and below another
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
