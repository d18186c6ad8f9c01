"""Missing values and ratios. The three coercions differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: Column) -> Column:
    return col.cast("string")


def count_or_zero(col: Column) -> Column:
    """A count cell: empty and null are 0; fractions are cut off."""
    return F.when(col.isNull() | (_text(col) == ""), F.lit(0).cast("long")).otherwise(_text(col).cast("double").cast("long"))


def count_or_zero_na(col: Column) -> Column:
    """As count_or_zero, and NA is 0."""
    return F.coalesce(count_or_null(col), F.lit(0).cast("long"))


def count_or_null(col: Column) -> Column:
    """Empty, null and NA are no value."""
    return F.when(~_text(col).isin("", "NA"), _text(col)).cast("double").cast("long")


def finite_or_null(col: Column) -> Column:
    """A measurement cell: empty, NA, NaN and infinities are no value."""
    value = F.when(~_text(col).isin("", "NA", "nan", "NaN"), _text(col)).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def cpm(count: Column, library: Column) -> Column:
    """Counts per million."""
    return F.coalesce(F.try_divide(count * F.lit(1e6), library.cast("double")), F.lit(0.0))


def percent_of(count: Column, total: Column) -> Column:
    """count * 100 / total, multiplied first."""
    return F.coalesce(F.try_divide(count * F.lit(100.0), total.cast("double")), F.lit(0.0))


def text_or_na(col: Column) -> Column:
    return F.coalesce(_text(col), F.lit("NA"))


def fixed(col: Column, places: int = 6) -> Column:
    """Fixed decimals, NA for null."""
    return F.when(col.isNull(), F.lit("NA")).otherwise(F.format_string(f"%.{places}f", col))
