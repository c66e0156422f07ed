"""Order statistics and modes with stated tie and index rules, as Column functions over arrays, and grouped modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, negative ones too."""
    return F.floor(x + F.lit(0.5))


def percent(n: Column, d: Column) -> Column:
    """n of d in per cent to one decimal; 0 where d is not positive."""
    return F.when(d > 0, half_up(n * 1000.0 / d) / 10.0).otherwise(F.lit(0.0))


def _at(values: Column, i: Column) -> Column:
    return F.get(F.sort_array(values), i.cast("int"))


def top_percentile(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(n * p))]."""
    n = F.size(values)
    return _at(values, F.least(n - 1, F.floor(n * F.lit(p))))


def low_quantile(values: Column, q: float) -> Column:
    """sorted[floor(q * (n - 1))], within bounds."""
    n = F.size(values)
    return _at(values, F.greatest(F.lit(0), F.least(n - 1, F.floor(F.lit(q) * (n - 1)))))


def upper_median(values: Column) -> Column:
    """sorted[floor(n / 2)]."""
    return _at(values, F.floor(F.size(values) / 2))


def first_mode(df: DataFrame, by: list[str], value: str, order: str, step: float, name: str) -> DataFrame:
    """Per group the bin floor(value / step + 0.5) * step that occurs most; of equals the one seen first by `order`."""
    binned = df.withColumn("__bin", half_up(F.col(value) / step) * F.lit(step)).groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    # The least of (fewer than the most, first seen) is the bin sought.
    return binned.groupBy(*by).agg(F.min_by("__bin", F.struct(-F.col("__n"), "__first")).alias(name))
