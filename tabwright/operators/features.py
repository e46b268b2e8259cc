"""New columns from numeric ones: log, degree-two polynomials, pairwise products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double, numeric_columns, ref
from tabwright.operators.select import select_features

# Fixed value: how many leading numeric columns are multiplied with each other.
INTERACTION_COLUMNS = 8


def fit_log_shift(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Amount to add to each column before the log: ``1 - min`` where the minimum is not positive."""
    if not columns:
        return {}
    row = df.agg(*[F.min(as_double(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    minima = {c: row[i] for i, c in enumerate(columns)}
    return {c: (1.0 - m if m is not None and m <= 0 else 0.0) for c, m in minima.items()}


def log_transform(df: DataFrame, shifts: Mapping[str, float]) -> DataFrame:
    """``ln(1 + x + shift)``; a value far enough under the learned minimum gives null."""
    logged = {c: F.log1p(as_double(c) + F.lit(s)).alias(c) for c, s in shifts.items()}
    return df.select(*[logged.get(c, ref(c)) for c in df.columns])


def polynomial_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns, squares and products of degree two, after the other columns: ``a``, ``a^2``, ``a b``."""
    kept = [ref(c) for c in df.columns if c not in set(columns)]
    linear = [as_double(c).alias(c) for c in columns]
    squared = [
        (as_double(a) * as_double(b)).alias(f"{a}^2" if a == b else f"{a} {b}")
        for a, b in combinations_with_replacement(columns, 2)
    ]
    return df.select(*kept, *linear, *squared)


def interaction_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products ``a__x__b`` of the first few columns, unless the name is taken."""
    taken = set(df.columns)
    products = [
        (as_double(a) * as_double(b)).alias(f"{a}__x__{b}")
        for a, b in combinations(list(columns)[:INTERACTION_COLUMNS], 2)
        if f"{a}__x__{b}" not in taken
    ]
    return df.select("*", *products)


def engineer_features(
    df: DataFrame,
    target: str,
    config: Mapping,
    task: str,
    key: Sequence[str] = (),
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Apply the steps that ``config`` switches on, then the feature selection.

    ``key`` columns identify a row; they are carried along and never used. ``fit_on`` learns shifts
    and the selection from another frame with the same columns.
    """
    source = df if fit_on is None else fit_on
    columns = numeric_columns(df, skip=[target, *key])
    steps = []
    if config.get("log_transform"):
        shifts = fit_log_shift(source, columns)
        steps.append(lambda d: log_transform(d, shifts))
    if config.get("polynomial_features") and columns:
        steps.append(lambda d: polynomial_features(d, columns))
    if config.get("feature_interactions") and len(columns) >= 2:
        steps.append(lambda d: interaction_features(d, columns))
    for step in steps:
        df, source = step(df), step(source)
    selection = config.get("feature_selection") or {}
    if not selection.get("enabled"):
        return df
    chosen = select_features(
        source.drop(*key),
        target,
        selection.get("method", "variance_threshold"),
        selection.get("k_features"),
        task,
    )
    return df.select(*[ref(c) for c in [*key, *chosen, target]])
