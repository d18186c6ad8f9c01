"""Positions as seen along the strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset(position: Column, feature: Column, strand: Column) -> Column:
    """How far downstream of the feature a position lies."""
    return F.when(strand == "+", position - feature).otherwise(feature - position)


def position_at(feature: Column, distance: Column, strand: Column) -> Column:
    return F.when(strand == "+", feature + distance).otherwise(feature - distance)


def three_prime(start: Column, end: Column, strand: Column) -> Column:
    """Last base in the direction of transcription."""
    return F.when(strand == "+", end).otherwise(start)


def range_offsets(start: Column, end: Column, anchor: Column, strand: Column) -> tuple[Column, Column]:
    """Offsets of a span's first and last base along the strand."""
    return F.when(strand == "+", start - anchor).otherwise(anchor - end), F.when(strand == "+", end - anchor).otherwise(anchor - start)


def range_offsets_symmetric_minus(start: Column, end: Column, anchor: Column, strand: Column) -> tuple[Column, Column]:
    """As range_offsets() on the plus strand; on the minus strand the range is symmetric about the anchor, reaching as far as its end does.

    This isn't what orientation means, but what the published long-read coverage is computed with.
    """
    reach = end - anchor
    return F.when(strand == "+", start - anchor).otherwise(-reach), reach


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part within [low, high]; empty where the first is above the second."""
    return F.greatest(start, low), F.least(end, high)
