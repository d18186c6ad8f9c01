"""Streams of intervals and events, an extension: the batch operators that need no whole table work on streams too.

Counts are by event time with a watermark, so state is bounded by the lateness that is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 16) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n, total): counts by window. Rows later than `late` are left out by Spark, as they must be for state to end."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, length, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys, n): rows with less than `gap` between them."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def assign_points(points: DataFrame, intervals: DataFrame, keys: list[str], position: str, start: str, end: str, size: int) -> DataFrame:
    """A stream of points joined with a table of intervals; the bins' equi join keeps no state."""
    from spanforge.operators.intervals import point_join

    return point_join(points, intervals, keys, position, start, end, size)
