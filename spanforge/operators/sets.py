"""Feature sets across samples, first-seen rows, checks of inputs, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_set(df: DataFrame, feature: str, count: Column) -> DataFrame:
    """Features with a count above 0 in any sample."""
    return df.where(count > 0).select(feature).distinct()


def shared_set(df: DataFrame, feature: str, sample: str, count: Column, least: int, n_samples: int) -> DataFrame:
    """Features with at least so many in each of the samples."""
    reached = df.where(count >= least).groupBy(feature).agg(F.count_distinct(sample).alias("__n"))
    return reached.where(F.col("__n") == n_samples).select(feature)


def analysis_set(df: DataFrame, feature: str, sample: str, count: Column, least: int, n_samples: int) -> DataFrame:
    """The union where no threshold is asked for, else the shared set."""
    return union_set(df, feature, count) if least <= 0 else shared_set(df, feature, sample, count, least, n_samples)


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def first_seen(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row of each key that came first; ordinal says in what order rows came."""
    return best_rows(df, keys, [F.col(ordinal)])


def with_default(left: DataFrame, right: DataFrame, keys: Sequence[str], values: dict[str, object]) -> DataFrame:
    """Lookup by key; a default where there is none."""
    return left.join(right.select(*keys, *values), list(keys), "left").withColumns({v: F.coalesce(F.col(v), F.lit(d)) for v, d in values.items()})


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which raises when a row breaks the condition, as it is run. Costs no job of its own."""
    return df.where(F.coalesce(F.assert_true(condition, F.lit(message)).isNull(), F.lit(True)))


def require_single(df: DataFrame, columns: Sequence[str], message: str) -> DataFrame:
    """One row with the columns' values, of which there must be exactly one each."""
    counts = df.agg(*[F.count_distinct(c).alias(f"__{c}") for c in columns], *[F.max(c).alias(c) for c in columns])
    fine = F.lit(True)
    for c in columns:
        fine &= F.col(f"__{c}") == 1
    return require(counts, fine, message).select(*columns)


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """df, which raises when keys repeat."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return require(df.withColumn("__n", n), F.col("__n") == 1, message).drop("__n")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """df, or an error if it is empty. Runs at most a job for a first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def row_where(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The first such row, which must be there."""
    found = df.where(condition).limit(1)
    return require_rows(found, message)


def pivot_samples(df: DataFrame, keys: Sequence[str], sample: str, samples: Sequence[str], values: dict[str, str]) -> DataFrame:
    """A column {sample}_{name} for each sample, in the given order, and each value; 0 where there is none. values: {name: column}."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(sample) == s, F.col(c))), F.lit(0)).alias(f"{s}_{name}") for s in samples for name, c in values.items()])


def ordered_text(sample: str, value: Column, ordinal: str) -> Column:
    """Aggregate: "a=1;b=2" of the rows with a value, in order."""
    items = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(ordinal).alias("o"), F.col(sample).alias("s"), value.cast("string").alias("v")))))
    return F.array_join(F.transform(items, lambda x: F.concat(x["s"], F.lit("="), x["v"])), ";")
