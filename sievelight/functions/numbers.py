"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    """NaN and NULL both mean missing in the data model; Spark's aggregates only skip NULL."""
    return F.when(~F.isnan(value), value)


def percent(part: Column, whole: Column, decimals: int = 1) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, decimals)


def scale_255(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: v / F.lit(255.0))


def gray_to_rgb(pixels: Column) -> Column:
    """Repeat a single channel three times, pixel by pixel."""
    return F.flatten(F.transform(pixels, lambda v: F.array_repeat(v, 3)))
