"""Row filters by z-score, interquartile range or isolation forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_double, numeric_columns
from tabwright.functions.quantiles import exact_medians, exact_quantiles
from tabwright.operators.isolation import isolation_filter

# Defaults of the three methods.
ZSCORE_THRESHOLD = 3.0
IQR_MULTIPLIER = 1.5
CONTAMINATION = 0.05


@dataclass(frozen=True)
class Fences:
    """Per column the value that stands in for null and the condition a kept row meets."""

    conditions: list[Column]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(and_, self.conditions)) if self.conditions else df


def fit_zscore(df: DataFrame, columns: Sequence[str], threshold: float = ZSCORE_THRESHOLD) -> Fences:
    """Keep a row if each value is less than ``threshold`` population deviations from the mean.

    Nulls count as the median. Columns without spread or without values take no part.
    """
    medians = exact_medians(df, columns)
    used = [c for c in columns if medians[c] is not None]
    if not used:
        return Fences([])
    filled = {c: F.coalesce(as_double(c), F.lit(medians[c])) for c in used}
    aggregates = []
    for i, c in enumerate(used):
        aggregates += [F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}")]
    row = df.agg(*aggregates).first()
    return Fences(
        [
            F.abs((filled[c] - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"])) < F.lit(threshold)
            for i, c in enumerate(used)
            if row[f"s{i}"] > 0
        ]
    )


def fit_iqr(df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER) -> Fences:
    """Keep a row if each value lies within the quartiles widened by ``multiplier`` ranges.

    Nulls count as the median, also in the quartiles. Columns without values take no part.
    """
    medians = exact_medians(df, columns)
    used = [c for c in columns if medians[c] is not None]
    if not used:
        return Fences([])
    filled = df.select(*[F.coalesce(as_double(c), F.lit(medians[c])).alias(c) for c in used])
    quartiles = exact_quantiles(filled, used, (0.25, 0.75))
    conditions = []
    for c in used:
        low, high = quartiles[c]
        reach = multiplier * (high - low)
        value = F.coalesce(as_double(c), F.lit(medians[c]))
        conditions.append(value.between(F.lit(low - reach), F.lit(high + reach)))
    return Fences(conditions)


def remove_outliers(
    df: DataFrame,
    target: str | None,
    method: str = "none",
    *,
    zscore_threshold: float = ZSCORE_THRESHOLD,
    iqr_multiplier: float = IQR_MULTIPLIER,
    contamination: float = CONTAMINATION,
    key: Sequence[str] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Drop outlier rows by ``method``; kept rows hold their original values, nulls included.

    ``key`` names columns that identify a row and are not tested. ``fit_on`` learns the limits from
    another frame, for instance the training part alone.
    """
    columns = numeric_columns(df, skip=[*([target] if target else []), *(key or [])])
    method = str(method).lower()
    if not columns:
        return df
    source = df if fit_on is None else fit_on
    if method == "zscore":
        return fit_zscore(source, columns, zscore_threshold).apply(df)
    if method == "iqr":
        return fit_iqr(source, columns, iqr_multiplier).apply(df)
    if method == "isolation_forest":
        return isolation_filter(df, columns, contamination, key=key, fit_on=source)
    return df
