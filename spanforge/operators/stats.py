"""Statistics over replicates, thresholds and lengths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import coerce

#: Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom, to three decimals.
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
T_95_LARGE = 1.96


def t_critical(n: Column, table_until: int = 30) -> Column:
    """Of a sample size; 0 below 2. Beyond the table the normal value holds."""
    values = F.array(*[F.lit(x) for x in T_95[:table_until]])
    return F.when(n < 2, F.lit(0.0)).when(n - 1 <= table_until, F.get(values, (n - 2).cast("int"))).otherwise(F.lit(T_95_LARGE))


def replicate_summary(df: DataFrame, keys: Sequence[str], values: Sequence[str], spread: Sequence[str] = ("mean", "sd", "sem", "ci95"), table_until: int = 30, skip_missing: bool = False) -> DataFrame:
    """(keys, replicate_count, {mean,sd,sem,ci95}_{value}). Fewer than two values have no spread: 0.

    skip_missing: cells may be text; NA and non-finite ones are left out, and a value without any is null.
    """
    cells = {v: coerce.finite_or_null(F.col(v)) if skip_missing else F.col(v).cast("double") for v in values}
    aggs: list[Column] = [F.count(F.lit(1)).alias("replicate_count")]
    for i, c in enumerate(cells.values()):
        aggs += [F.avg(c).alias(f"__m{i}"), F.stddev_samp(c).alias(f"__s{i}"), F.count(c).alias(f"__n{i}")]
    grouped = df.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col("replicate_count")]
    for i, v in enumerate(values):
        n = F.col(f"__n{i}")
        there = lambda x, n=n: F.when(n > 0, x)
        sd = F.coalesce(F.col(f"__s{i}"), F.lit(0.0))
        sem = sd / F.sqrt(F.greatest(n, F.lit(1)))
        of = {"mean": F.col(f"__m{i}"), "sd": there(sd), "sem": there(sem), "ci95": there(sem * t_critical(n, table_until))}
        out += [of[s].alias(f"{s}_{v}") for s in spread]
    return grouped.select(*out)


def percentile_cutoffs(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(percentile, cutoff), by linear interpolation. Rows are counted by value first, and the running counts of values, which may spill, tell where each percentile lies. Cutoffs are rounded to nine places, so that the last bit of an interpolation decides nothing."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("__v")
    placed = counts.withColumn("__up", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__next", F.lead("__v").over(order))
    total = counts.agg(F.sum("__n").alias("__total"))
    wanted = total.where(F.col("__total") > 0).select("__total", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("percentile")).withColumn("__at", F.lit(1.0) * F.col("percentile") / 100 * (F.col("__total") - 1))
    # rows are numbered from 0: a value with `up` rows up to it stands last at up - 1
    here = placed.join(F.broadcast(wanted), (F.floor("__at") >= F.col("__up") - F.col("__n")) & (F.floor("__at") < F.col("__up")))
    after = F.when((F.floor("__at") + 1 < F.col("__up")) | F.col("__next").isNull(), F.col("__v")).otherwise(F.col("__next"))
    share = F.col("__at") - F.floor("__at")
    return here.select(F.col("percentile").cast("int").alias("percentile"), F.round(F.col("__v") + (after - F.col("__v")) * share, 9).alias("cutoff"))


def threshold_curve(df: DataFrame, value: str, present: Column, other: str, low: int, high: int, thinning: Column) -> DataFrame:
    """For each percentile of value: how many rows reach its cutoff, how many of those are present in the other condition, their sums, and how many would be by chance if each unit were seen with probability `thinning`.

    The cutoffs are at most 101 rows, so they are broadcast; rows are summed by their highest percentile first, and the sums from each percentile up make the curve.
    """
    cutoffs = percentile_cutoffs(df, value, low, high)
    levels = cutoffs.agg(F.sort_array(F.collect_list(F.struct("percentile", "cutoff"))).alias("levels"))
    n_reached = F.size(F.filter("levels", lambda x: x["cutoff"] <= F.col("__value").cast("double")))
    # Cutoffs rise, so a row reaches a first stretch of them.
    counted = (
        df.select(F.col(value).alias("__value"), present.cast("int").alias("__present"), F.col(other).alias("__other"), thinning.alias("__p"))
        .withColumn("__expected", F.lit(1.0) - F.pow(F.lit(1.0) - F.col("__p"), F.col("__value").cast("double")))
        .crossJoin(F.broadcast(levels))
        .withColumn("__reached", n_reached)
        .groupBy("__reached")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("__present").alias("c"), F.sum("__value").alias("r"), F.sum("__other").alias("q"), F.sum("__expected").alias("e"))
    )
    placed = cutoffs.withColumn("__at", F.row_number().over(Window.orderBy("percentile")))
    joined = placed.join(F.broadcast(counted), F.col("__reached") >= F.col("__at"), "left")
    return joined.groupBy("percentile", "cutoff").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("selected"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("covered"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("value_sum"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("other_sum"),
        F.coalesce(F.sum("e"), F.lit(0.0)).alias("expected"),
    )


def discrete_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(keys, q10, ...): the smallest value up to which at least that share of rows lies. Rows are counted by value first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    up_to = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    placed = counts.withColumn("__up", up_to).withColumn("__total", total)
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("__up") >= F.col("__total") * F.lit(q), F.col(value))).alias(f"q{round(q * 100)}") for q in quantiles])


def most_common(df: DataFrame, keys: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """(keys, value, count): the commonest value; of equally common ones the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("count"), F.min(ordinal).alias("__first"))
    best = F.max_by(F.struct(value, "count"), F.struct(F.col("count"), -F.col("__first")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{value}").alias(value), F.col("b.count").alias("count"))


def welch(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: means, t, degrees of freedom. A single value or no spread gives null."""
    moments = {}
    for mark, name in (("a", first), ("b", second)):
        x = F.when(F.col(group) == name, F.col(value).cast("double"))
        moments |= {f"mean_{mark}": F.avg(x), f"var_{mark}": F.var_samp(x), f"n_{mark}": F.count(x)}
    row = df.agg(*[v.alias(k) for k, v in moments.items()])
    a, b = (F.try_divide(F.col(f"var_{m}"), F.col(f"n_{m}")) for m in "ab")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(a + b))
    df_ = F.try_divide(F.pow(a + b, F.lit(2)), F.try_divide(a * a, F.col("n_a") - 1) + F.try_divide(b * b, F.col("n_b") - 1))
    return row.select("mean_a", "mean_b", "n_a", "n_b", t.alias("t"), df_.alias("df"))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function. For the one row of a test."""
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def welch_test(df: DataFrame, group: str, value: str, first: str, second: str) -> dict[str, float | None]:
    """welch() with its two-sided p-value."""
    row = welch(df, group, value, first, second).first().asDict()
    row["p_value"] = t_two_sided(row["t"], row["df"]) if row["t"] is not None and row["df"] is not None else None
    return row


def composition(df: DataFrame, keys: Sequence[str], category: str, count: str) -> DataFrame:
    """(keys, category, count, percent): each category's share of its keys' total."""
    sums = df.groupBy(*keys, category).agg(F.sum(count).alias(count))
    return sums.withColumn("percent", coerce.percent_of(F.col(count), F.sum(count).over(Window.partitionBy(*keys))))
