"""Subsamples and lanes for drawing reads."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_sample(df: DataFrame, keys: Sequence[str], cap: Column, order: Sequence[Column]) -> DataFrame:
    """At most cap rows of each group, the first in the given order. An order by a hash makes a sample that any run repeats."""
    ranked = df.withColumn("__cap", cap).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= F.col("__cap")).drop("__rank", "__cap")


def seeded(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def pack_lanes(df: DataFrame, keys: Sequence[str], start: str = "xmin", end: str = "xmax", tie: str = "read_name", lane: str = "pack_lane") -> DataFrame:
    """Each interval in the first lane whose last interval ends before it starts, in order of start, end and tie.

    Which lane is free depends on all intervals before, so a group is packed in one go; groups are the few hundred reads that capped_sample() leaves.
    """
    schema = df.schema.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{lane}` int")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([start, end, tie], kind="stable")
        ends: list[int] = []
        lanes = []
        for a, b in zip(group[start], group[end]):
            at = next((i for i, e in enumerate(ends) if e < a), len(ends))
            if at == len(ends):
                ends.append(b)
            else:
                ends[at] = b
            lanes.append(at + 1)
        return group.assign(**{lane: lanes})

    return df.groupBy(*keys).applyInPandas(pack, schema)


def stack_lanes(rows: DataFrame, order: Sequence[str], size: str, gap: int = 2) -> DataFrame:
    """rows, one for each group, with y_offset: the lanes and gaps of all groups before it, in order. The rows are as many as samples."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("y_offset", F.coalesce(F.sum(F.col(size) + gap).over(before), F.lit(0)))


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "row_rank") -> DataFrame:
    """df with the place of each row in the given order, from 1, as a writer of sorted rows would put it.

    Rows are sorted in ranges; only the number of rows of each range is gathered. Rows that are equal in the order have any of their places. The sorted rows are kept.
    """
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("__at", 33)
    before, up_to = {}, 0
    for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before[r["part"]] = up_to
        up_to += r["n"]
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (offsets[part] + row + 1).cast("long")).drop("__at")
