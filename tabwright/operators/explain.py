"""Feature importance of a fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.small import local_copy, local_frame, task_count
from tabwright.operators.kernel_shap import kernel_shap
from tabwright.operators.prep import feature_names
from tabwright.operators.tree_shap import TREE_MODELS, tree_shap
from tabwright.session import materialise

# Rows explained, background rows, and the length of the list.
EXPLAINED_ROWS = 200
BACKGROUND_ROWS = 100
TOP_K = 20
RUN_TOP_K = 30
SAMPLE_SEED = 42


def mean_absolute(values: DataFrame, names: Sequence[str], column: str = "shap") -> DataFrame:
    """``(feature, importance)``: mean over rows of the mean absolute value over outputs."""
    size = F.size("_per_output").cast("double")
    one = values.select(F.posexplode(column).alias("_slot", "_per_output")).select(
        "_slot", (F.aggregate("_per_output", F.lit(0.0), lambda a, v: a + F.abs(v)) / size).alias("_value")
    )
    named = local_frame(values.sparkSession, list(enumerate(names)), "_slot int, feature string")
    means = one.groupBy("_slot").agg(F.avg("_value").alias("importance"))
    return means.join(F.broadcast(named), "_slot").select("feature", "importance")


def native_importance(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """Tree importances, else absolute coefficients, else ones."""
    model = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = np.ones(len(names))
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).ravel()
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    rows = [(name, float(value)) for name, value in zip(names, values)]
    return local_frame(spark, rows, "feature string, importance double")


def top_features(importance: DataFrame, k: int = TOP_K) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def steady_rows(vectors: DataFrame, rows: int) -> DataFrame:
    """That many rows, the same ones however the table is cut: the first in an order by hash of the features."""
    values = vector_to_array(F.col("features"))
    return vectors.orderBy(F.xxhash64(F.lit(SAMPLE_SEED), values), values).limit(rows)


def feature_importance(
    vectors: DataFrame,
    model: Model,
    top_k: int = TOP_K,
    rows: int | None = EXPLAINED_ROWS,
    background_rows: int = BACKGROUND_ROWS,
) -> DataFrame:
    """Explain ``model`` over a frame with ``features`` and rank the mean absolute Shapley values.

    Tree models use their own structure, others the model-free estimate. ``rows=None`` explains
    every row of the frame. A model that neither can explain falls back to its own importances.
    """
    names = feature_names(vectors)
    chosen = vectors.select("features")
    if rows is not None:
        chosen = local_copy(steady_rows(chosen, rows), rows).repartition(task_count(vectors.sparkSession))
    try:
        if isinstance(model, TREE_MODELS):
            explained = tree_shap(chosen, model)
        else:
            keyed = materialise(chosen.withColumn("_row", F.monotonically_increasing_id()))
            sample = local_copy(steady_rows(vectors.select("features"), background_rows), background_rows)
            explained = kernel_shap(keyed, model, sample, "_row")
        importance = local_copy(mean_absolute(explained, names))
    except ValueError:
        importance = native_importance(vectors.sparkSession, model, names)
    return top_features(importance, top_k)
