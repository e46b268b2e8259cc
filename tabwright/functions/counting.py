"""Counts of distinct values for many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import ref


def value_counts(df: DataFrame, columns: Sequence[str], value_type: str = "string") -> DataFrame:
    """``(column, value, n)`` over the non-null values of all ``columns``.

    The columns are unpivoted first, so one partially aggregated shuffle serves them all and a
    value that holds most of the rows reaches its reducer as one row per map task.
    """
    stacked = df.select(*[ref(c).cast(value_type).alias(c) for c in columns]).unpivot(
        [], [ref(c) for c in columns], "column", "value"
    )
    return stacked.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame) -> DataFrame:
    """``(column, levels, total, top, freq)`` from ``value_counts``; the smallest value wins a tie."""
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum("n").alias("total"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )
