"""Counts and coverage about features, on dense grids of offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import coerce


def grid(groups: DataFrame, low: Column | int, high: Column | int, name: str = "offset_nt") -> DataFrame:
    """Every offset of [low, high] for each row of groups."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return groups.withColumn(name, F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def dense(counts: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], low: int, high: int, name: str = "offset_nt") -> DataFrame:
    """counts on the whole grid of each group, 0 where there is none. Groups without any count are there too; counts outside the window aren't."""
    full = grid(groups, low, high, name)
    inside = counts.where(F.col(name).between(low, high)).select(*keys, F.col(name).cast("int").alias(name), *values)
    joined = full.join(inside, [*keys, name], "left")
    return joined.select(*[c for c in full.columns], *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def histogram(df: DataFrame, keys: Sequence[str], name: str = "offset_nt", count: str = "read_count") -> DataFrame:
    return df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias(count))


def range_coverage(df: DataFrame, keys: Sequence[str], first: Column, last: Column, low: int, high: int, weight: Column | None = None, name: str = "offset_nt", count: str = "coverage_count", zeros: bool = False) -> DataFrame:
    """How many ranges [first, last] cover each offset of [low, high], by keys.

    A range adds at its first offset and subtracts after its last, so a row costs two events whatever its length. Events are summed before the shuffle; the running sum then sees at most one row for each offset.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    clipped = df.select(*keys, F.greatest(first, F.lit(low)).cast("int").alias("__a"), F.least(last, F.lit(high)).cast("int").alias("__b"), weight.alias("__w")).where(F.col("__a") <= F.col("__b"))
    events = clipped.select(*keys, F.explode(F.array(F.struct(F.col("__a").alias("at"), F.col("__w").alias("d")), F.struct((F.col("__b") + 1).alias("at"), (-F.col("__w")).alias("d")))).alias("e"))
    deltas = events.groupBy(*keys, F.col("e.at").alias(name)).agg(F.sum("e.d").alias("__d"))
    order = Window.partitionBy(*keys).orderBy(name)
    steps = deltas.withColumn(count, F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead(name).over(order))
    spread = steps.where(F.col("__next").isNotNull()).withColumn(name, F.explode(F.sequence(F.col(name), F.col("__next") - 1))).select(*keys, name, count)
    return spread if zeros else spread.where(F.col(count) != 0)


def starts_to_coverage(starts: DataFrame, keys: Sequence[str], limits: DataFrame, limit: str, low: int, high: int, name: str = "offset_nt", count: str = "read_count", out: str = "coverage_count", total_by: Sequence[str] = ()) -> DataFrame:
    """Fragments that began at or before each offset of [low, high], as long as the offset is at most the feature's limit, summed over features, by total_by and offset.

    starts: counts by feature (keys) and offset; starts below the window count from its first offset on. limits: one row for each feature with its limit. Each start adds 1 at its offset and is taken off after the limit, which needs no grid for each feature.
    """
    bounded = starts.join(limits, [k for k in keys if k in limits.columns])
    first, last = F.greatest(F.col(name), F.lit(low)), F.least(F.col(limit), F.lit(high))
    return range_coverage(bounded, list(total_by), first, last, low, high, F.col(count), name, out)


def with_rates(df: DataFrame, count: str, library: Column, total: Column, prefix: str, fraction: str, percent: str, percent_first: bool = False) -> DataFrame:
    """Adds counts per million, fraction and percent of a count. percent_first: multiplied by 100 before the division."""
    c = F.col(count)
    share = coerce.ratio(c, total)
    return df.withColumns({f"{prefix}cpm": coerce.cpm(c, library), fraction: share, percent: coerce.percent_of(c, total) if percent_first else share * F.lit(100.0)})


def max_normalised(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """value over its largest within the keys; null where that is 0."""
    return df.withColumn(out, coerce.ratio_or_null(F.col(value), F.max(value).over(Window.partitionBy(*keys))))


def area_above_baseline(df: DataFrame, keys: Sequence[str], position: str, value: str, baseline_until: int = 10, low: int = -4, high: int = 2) -> DataFrame:
    """(keys, baseline, area_under_peak): the median of the values up to a position, and what the values in [low, high] are above it."""
    baseline = df.where(F.col(position) <= baseline_until).groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("baseline"))
    peak = df.where(F.col(position).between(low, high)).groupBy(*keys).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    both = baseline.join(peak, list(keys), "left")
    return both.select(*keys, "baseline", (F.coalesce("__sum", F.lit(0.0)) - F.col("baseline") * F.coalesce("__n", F.lit(0))).alias("area_under_peak"))
