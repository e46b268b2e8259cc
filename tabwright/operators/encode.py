"""Integer codes of text columns and of the target, in sorted order from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame, functions as F, types as T

from tabwright.functions.columns import ref, require_columns
from tabwright.functions.counting import value_counts
from tabwright.functions.ordering import sorted_positions
from tabwright.functions.small import broadcast_if_small, settled

TARGET_LEVELS = 10_000


TEXT_LIKE = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Text columns; dates and times count as text."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEXT_LIKE) and f.name not in skip]


def level_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``: place of each non-null value in the sorted values of its column."""
    levels = settled(value_counts(df, columns).select("column", "value"))
    placed = sorted_positions(levels, ["column", "value"])
    first = placed.groupBy("column").agg(F.min("position").alias("first"))
    return placed.join(broadcast_if_small(first), "column").select(
        "column", "value", (F.col("position") - F.col("first")).alias("code")
    )


def label_encode(df: DataFrame, columns: Sequence[str] | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Replace text columns by their codes; null and values without a code become -1."""
    columns = list(columns) if columns is not None else text_columns(df)
    if not columns:
        return df
    codes = settled(level_codes(df, columns) if codes is None else codes)
    result = df
    for i, c in enumerate(columns):
        lookup = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        result = result.join(broadcast_if_small(lookup), ref(c).cast("string") == F.col(f"_v{i}"), "left")
    place = {c: F.coalesce(F.col(f"_c{i}"), F.lit(-1)).cast("bigint").alias(c) for i, c in enumerate(columns)}
    return result.select(*[place.get(c, ref(c)) for c in df.columns])


def target_labels(df: DataFrame, target: str) -> list[str]:
    """The target's distinct values as text, numbers in numeric order and text in byte order."""
    require_columns(df, target)
    values = df.where(ref(target).isNotNull()).select(ref(target).alias("v")).distinct()
    rows = values.orderBy("v").select(F.col("v").cast("string")).take(TARGET_LEVELS + 1)
    if len(rows) > TARGET_LEVELS:
        raise ValueError(f"target {target} has more than {TARGET_LEVELS} classes")
    return [r[0] for r in rows]


def target_indexer(labels: Sequence[str], target: str, output: str = "label") -> StringIndexerModel:
    """Stage that writes the code of each target value; rows with another value are an error."""
    return StringIndexerModel.from_labels(list(labels), inputCol=target, outputCol=output, handleInvalid="error")


def target_names(labels: Sequence[str], code: str = "prediction", output: str = "predicted") -> IndexToString:
    """Stage that turns codes back into target values."""
    return IndexToString(inputCol=code, outputCol=output, labels=list(labels))
