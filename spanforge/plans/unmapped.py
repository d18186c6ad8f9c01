"""Lengths and ends of reads that didn't map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import stats


def summary(reads: DataFrame) -> DataFrame:
    """One row for each mate of reads (mate, ordinal, sequence): counts, lengths, discrete quantiles, and the commonest first and last twelve bases, ties going to the one seen first."""
    cut = reads.select("mate", "ordinal", F.length("sequence").cast("long").alias("n"), F.substring("sequence", 1, 12).alias("prefix"), F.expr("right(sequence, 12)").alias("suffix"))
    n = F.col("n")
    base = cut.groupBy("mate").agg(F.count(F.lit(1)).alias("total_reads"), F.round(F.avg(n), 2).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), *[F.count_if(n <= k).alias(f"reads_le_{k}") for k in (20, 30, 40)])
    quantiles = stats.discrete_quantiles(cut, ["mate"], "n", [0.1, 0.25, 0.5, 0.75, 0.9]).withColumnsRenamed({"q10": "p10_length", "q25": "p25_length", "q50": "median_length", "q75": "p75_length", "q90": "p90_length"})
    out = base.join(quantiles, "mate")
    for end in ("prefix", "suffix"):
        top = stats.most_common(cut, ["mate"], end, "ordinal").withColumnsRenamed({end: f"top_{end}_12", "count": f"top_{end}_12_count"})
        out = out.join(top, "mate")
    return out.orderBy("mate").select("mate", "total_reads", "mean_length", "min_length", "p10_length", "p25_length", "median_length", "p75_length", "p90_length", "max_length", "reads_le_20", "reads_le_30", "reads_le_40", "top_prefix_12", "top_prefix_12_count", "top_suffix_12", "top_suffix_12_count")


def summary_of_mates(reads: DataFrame, mates: tuple[str, ...] = ("R1", "R2")) -> DataFrame:
    """As summary(), with a row of zeros for a mate without a read."""
    spark = reads.sparkSession
    named = spark.createDataFrame([(m,) for m in mates], "mate string")
    found = named.join(summary(reads), "mate", "left")
    return found.na.fill(0).na.fill("").orderBy("mate")
