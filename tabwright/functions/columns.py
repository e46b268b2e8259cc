"""Column names, roles and null handling shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col(quoted(name))


def require_columns(df: DataFrame, *names: str) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}; the table has {', '.join(df.columns)}")


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    """Numeric columns in table order; booleans are not numbers here."""
    left_out = set(skip)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


@dataclass(frozen=True)
class Roles:
    numerical: list[str]
    categorical: list[str]


def column_roles(df: DataFrame, target: str | None) -> Roles:
    """Numbers and booleans are numerical; every other column but the target is categorical."""
    numerical, categorical = [], []
    for field in df.schema.fields:
        if field.name == target:
            continue
        is_number = isinstance(field.dataType, (T.NumericType, T.BooleanType))
        (numerical if is_number else categorical).append(field.name)
    return Roles(numerical, categorical)


def fold_nan(df: DataFrame) -> DataFrame:
    """Turn float NaN into null, the only missing value the operators know."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(c)), ref(c)).alias(c) if c in floats else ref(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return ref(name).cast("double")


def rows_from_wide(wide: DataFrame, names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn a one-row frame of aggregates into one row per entry of ``rows``."""
    structs = [F.struct(*[value.alias(name) for name, value in zip(names, row)]) for row in rows]
    return wide.select(F.inline(F.array(*structs)))
