"""Small frames held on the driver, and broadcast joins behind a check of the size."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabwright.session import materialise

BROADCAST_ROWS = 100_000
TASK_ROWS = 65_536  # most rows that a task of a training holds


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """Frame from driver rows. Through Arrow it becomes a local relation, which needs no Python worker."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if any(isinstance(f.dataType, T.UserDefinedType) for f in fields):
        return spark.createDataFrame(list(rows), fields)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.table(columns, schema=arrow), fields)


def local_copy(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The frame as driver rows if it has at most ``limit`` of them, so later uses cost no job."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return None
    return local_frame(df.sparkSession, rows, df.schema)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a lookup table for broadcast if it has at most ``limit`` rows.

    A larger one is returned as it is, for a shuffled join that AQE may split where keys are hot.
    """
    copy = local_copy(df, limit)
    return df if copy is None else F.broadcast(copy)


def task_count(spark: SparkSession) -> int:
    """Partitions for rows that each cause much work, so that small frames still use every core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, limit: int = TASK_ROWS) -> DataFrame:
    """The rows in even partitions of about ``limit``; as they are if there are no more of them.

    Files of few columns are read by few tasks, whatever the training then holds per row.
    """
    parts = math.ceil(df.count() / limit)
    return df.repartition(parts) if parts > 1 else df


def settled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A frame that later uses do not compute again: driver rows if small, else a checkpoint."""
    copy = local_copy(df, limit)
    return materialise(df) if copy is None else copy
