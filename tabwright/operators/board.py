"""Ranking of trained models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions.small import local_frame
from tabwright.operators.metrics import CLASS_METRICS, VALUE_METRICS, lower_is_better, metric_key

# Fixed value: rows of the board and of the importance list shown on a page.
DISPLAY_ROWS = 10


def board_rows(spark: SparkSession, results: Sequence[dict], task: str) -> DataFrame:
    """One row per trained model: name, training seconds to two decimals, and the task's metrics."""
    metrics = CLASS_METRICS if task == "classification" else VALUE_METRICS
    schema = "model string, training_time double, " + ", ".join(f"{m} double" for m in metrics)
    rows = [
        (r["model"], round(float(r["training_time"]), 2), *[r["metrics"].get(m) for m in metrics]) for r in results
    ]
    return local_frame(spark, rows, schema)


def ranking(metric: str) -> list[Column]:
    key = F.col(metric_key(metric))
    first = key.asc_nulls_last() if lower_is_better(metric) else key.desc_nulls_last()
    return [first, F.col("training_time").asc(), F.col("model").asc()]


def leaderboard(rows: DataFrame, metric: str) -> DataFrame:
    """Best model first by the metric in its direction, then the faster one."""
    return rows.orderBy(*ranking(metric))


def best_model(rows: DataFrame, metric: str) -> DataFrame:
    """The leading row with the metric's name and value beside it."""
    key = metric_key(metric)
    return leaderboard(rows, metric).limit(1).select(
        "model", F.lit(key).alias("metric_name"), F.col(key).alias("metric_value"), "training_time"
    )


def display(rows: DataFrame, metric: str, size: int = DISPLAY_ROWS) -> DataFrame:
    return leaderboard(rows, metric).limit(size)
