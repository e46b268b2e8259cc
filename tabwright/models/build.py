"""Turns a model name and its parameters into a Spark estimator."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tabwright.models.boosting import BoostedTrees
from tabwright.models.catalog import check_model
from tabwright.models.kernel import KernelMap
from tabwright.models.knn import KNNClassifier

SEED = 42
DEEPEST = 18
HUBER_BASE = 1.0


@dataclass(frozen=True)
class TrainFacts:
    """What the parameter rules need to know about the training frame."""

    rows: int
    classes: int = 0
    label_std: float = 1.0

    @classmethod
    def of(cls, train: DataFrame, task: str) -> TrainFacts:
        row = train.agg(
            F.count(F.lit(1)).alias("n"), F.max("label").alias("top"), F.stddev_pop("label").alias("spread")
        ).first()
        if task == "classification":
            return cls(row["n"], int(row["top"] or 0) + 1)
        return cls(row["n"], 0, row["spread"] or 1.0)


def build_model(name: str, task: str, params: Mapping[str, Any] | None, facts: TrainFacts) -> Estimator:
    """Estimator over ``features`` and ``label`` that writes ``prediction`` and, for classes, ``probability``."""
    check_model(name, task)
    params = dict(params or {})
    if name == "LogisticRegression":
        return LogisticRegression(
            maxIter=1000,
            elasticNetParam=0.0,
            standardization=False,
            regParam=1.0 / (params.get("C", 1.0) * facts.rows),
        )
    if name == "GaussianNB":
        return NaiveBayes(modelType="gaussian")
    if name == "KNeighborsClassifier":
        return KNNClassifier(k=params.get("n_neighbors", 5), weights=params.get("weights", "uniform"))
    if name == "LinearRegression":
        return LinearRegression(regParam=0.0, solver="auto")
    if name == "Ridge":
        return LinearRegression(
            elasticNetParam=0.0,
            standardization=False,
            regParam=params.get("alpha", 1.0) / facts.rows * facts.label_std,
        )
    if name == "Lasso":
        return LinearRegression(
            elasticNetParam=1.0, standardization=False, maxIter=3000, regParam=params.get("alpha", 1.0)
        )
    if name.startswith("RandomForest"):
        return _forest(task, params)
    if name in ("SVC", "SVR"):
        return _kernel_machine(name, params, facts)
    return _boosted(name, task, params, facts)


def _forest(task: str, params: Mapping[str, Any]) -> Estimator:
    # There is no limit on the size of a split node, so both halves get at least half of it.
    leaf = max(params.get("min_samples_leaf", 1), math.ceil(params.get("min_samples_split", 2) / 2))
    options = {
        "numTrees": params.get("n_estimators", 100),
        "maxDepth": params.get("max_depth", DEEPEST),
        "minInstancesPerNode": leaf,
        "seed": SEED,
    }
    if task == "classification":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **options)
    return RandomForestRegressor(featureSubsetStrategy="all", **options)


def _boosted(name: str, task: str, params: Mapping[str, Any], facts: TrainFacts) -> Estimator:
    """Boosted trees: by depth with regularised Newton steps, by leaves, or plain gradient boosting."""
    rounds, subsample = params.get("n_estimators", 100), params.get("subsample", 1.0)
    if task == "regression":
        loss = {"objective": "squared"}
    else:
        loss = {"objective": "logistic" if facts.classes <= 2 else "softmax", "classes": max(facts.classes, 2)}
    if name.startswith("XGB"):
        return BoostedTrees(
            rounds=rounds,
            subsample=subsample,
            rate=params.get("learning_rate", 0.3),
            maxDepth=params.get("max_depth", 6),
            regLambda=params.get("reg_lambda", 1.0),
            minGain=params.get("gamma", 0.0),
            minWeight=params.get("min_child_weight", 1.0),
            columnShare=params.get("colsample_bytree", 1.0),
            seed=SEED,
            **loss,
        )
    if name.startswith("LGBM"):
        return BoostedTrees(
            rounds=rounds,
            subsample=subsample,
            byGradient=params.get("data_sample_strategy", "bagging") == "goss",
            rate=params.get("learning_rate", 0.1),
            maxDepth=max(params.get("max_depth", 0), 0),
            maxLeaves=params.get("num_leaves", 31),
            regLambda=params.get("reg_lambda", 0.0),
            minGain=params.get("min_split_gain", 0.0),
            minWeight=params.get("min_child_weight", 1e-3),
            minRows=params.get("min_child_samples", 20),
            columnShare=params.get("colsample_bytree", 1.0),
            seed=SEED,
            **loss,
        )
    depth, rate = params.get("max_depth", 3), params.get("learning_rate", 0.1)
    if loss["objective"] == "softmax":
        return BoostedTrees(
            rounds=rounds, subsample=subsample, rate=rate, maxDepth=depth, regLambda=0.0, minWeight=0.0, newton=False, seed=SEED, **loss
        )
    options = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "subsamplingRate": subsample, "seed": SEED}
    return GBTRegressor(**options) if task == "regression" else GBTClassifier(**options)


def _one_vs_rest(classifier: Estimator, features: str) -> list[Estimator]:
    """One model per class, then a logistic fit on their margins for the probabilities."""
    classifier = classifier.copy(
        {classifier.getParam("featuresCol"): features, classifier.getParam("rawPredictionCol"): "margins"}
    )
    return [
        OneVsRest(classifier=classifier, featuresCol=features, rawPredictionCol="margins"),
        LogisticRegression(featuresCol="margins", rawPredictionCol="_raw", predictionCol="_calibrated"),
    ]


def _kernel_machine(name: str, params: Mapping[str, Any], facts: TrainFacts) -> Estimator:
    """A linear model on kernel features. The support vector regressor's loss becomes Huber's."""
    mapped = KernelMap(
        inputCol="features", outputCol="kernel_features", kernel=params.get("kernel", "rbf"), gamma=params.get("gamma", "scale")
    )
    strength = 1.0 / (params.get("C", 1.0) * facts.rows)
    if name == "SVR":
        loss = LinearRegression(
            featuresCol="kernel_features",
            loss="huber",
            epsilon=HUBER_BASE + params.get("epsilon", 0.1),
            elasticNetParam=0.0,
            standardization=False,
            regParam=strength,
        )
        return Pipeline(stages=[mapped, loss])
    svm = LinearSVC(regParam=strength, standardization=False, featuresCol="kernel_features")
    if facts.classes > 2:
        return Pipeline(stages=[mapped, *_one_vs_rest(svm, "kernel_features")])
    svm.setRawPredictionCol("margins")
    platt = LogisticRegression(featuresCol="margins", rawPredictionCol="_raw", predictionCol="_calibrated")
    return Pipeline(stages=[mapped, svm, platt])


def scored_columns(predicted: DataFrame, *keep: str) -> DataFrame:
    """``label``, ``prediction`` and, where the model gives probabilities, ``scores`` by class code."""
    columns = [F.col(c) for c in keep if c in predicted.columns]
    columns += [F.col("label"), F.col("prediction")]
    if "probability" in predicted.columns:
        columns.append(vector_to_array(F.col("probability")).alias("scores"))
    return predicted.select(*columns)
