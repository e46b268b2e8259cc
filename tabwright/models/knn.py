"""Nearest-neighbour classifier as a pipeline stage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.operators.neighbours import k_nearest, nearest_neighbours, vote
from tabwright.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
QUERY_CHUNK = 256
DISTANCE_BYTES = 64 * 1024 * 1024  # largest matrix of distances that a task makes at once


def query_chunk(rows: int) -> int:
    """How many queries meet all training rows at once: their matrix of distances is bounded."""
    return max(1, min(QUERY_CHUNK, DISTANCE_BYTES // (8 * max(rows, 1))))


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    broadcastBytes = Param(
        Params._dummy(), "broadcastBytes", "largest training set held whole by each task", TypeConverters.toInt
    )
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)


class KNNClassifier(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the training rows, numbered, in the shared folder."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        probabilityCol="probability",
        k=5,
        weights="uniform",
        broadcastBytes=BROADCAST_BYTES,
    ):
        super().__init__()
        self._setDefault(k=5, weights="uniform", broadcastBytes=BROADCAST_BYTES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNModel:
        points = dataset.select(
            F.monotonically_increasing_id().alias("id"),
            vector_to_array(F.col(self.getFeaturesCol())).alias("v"),
            F.col(self.getLabelCol()).cast("double").alias("label"),
        )
        points = materialise(points)
        top = points.agg(F.max("label")).first()[0]
        model = KNNModel(points)
        model._set(
            classes=int(top or 0) + 1,
            **{
                p.name: self.getOrDefault(p)
                for p in (
                    self.featuresCol,
                    self.labelCol,
                    self.predictionCol,
                    self.probabilityCol,
                    self.k,
                    self.weights,
                    self.broadcastBytes,
                )
            },
        )
        return model


class KNNModel(Model, _KNNParams, MLWritable, MLReadable):
    def __init__(self, points: DataFrame | None = None):
        super().__init__()
        self.points = points

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = self.points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        if (size["n"] or 0) * ((size["d"] or 0) + 2) * 8 <= self.getOrDefault("broadcastBytes"):
            return self._scan(dataset)
        return self._join(dataset)

    def _scan(self, dataset: DataFrame) -> DataFrame:
        """Training rows within the byte limit go to every task, so the query rows stay where they are."""
        rows = self.points.orderBy("id").collect()
        train = np.array([r["v"] for r in rows])
        ids = np.array([r["id"] for r in rows])
        label = np.array([r["label"] for r in rows]).astype(int)
        shared = dataset.sparkSession.sparkContext.broadcast((train, ids, label))
        chunk = query_chunk(len(rows))
        k, classes, by_distance = self.getOrDefault("k"), self.getOrDefault("classes"), self.getOrDefault("weights") == "distance"

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            train, ids, label = shared.value
            for batch in batches:
                result = []
                for start in range(0, len(batch), chunk):
                    query = np.stack(batch.iloc[start : start + chunk].to_numpy())
                    for near, away in k_nearest(query, train, ids, k):
                        weight = np.ones(len(near))
                        if by_distance:
                            weight = (away == 0).astype(float) if (away == 0).any() else 1.0 / away
                        votes = np.bincount(label[near], weights=weight, minlength=classes)
                        result.append(votes / votes.sum())
                yield pd.Series(result)

        scored = dataset.withColumn("_scores", scores(vector_to_array(F.col(self.getFeaturesCol()))))
        return self._finish(scored, (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double"))

    def _join(self, dataset: DataFrame) -> DataFrame:
        """Beyond the limit both sides are packed and joined; the numbered query is written first."""
        query = materialise(dataset.withColumn("_query", F.monotonically_increasing_id()))
        asked = query.select("_query", vector_to_array(F.col(self.getFeaturesCol())).alias("v"))
        found = nearest_neighbours(self.points, asked, self.getOrDefault("k"), "id", "_query", "v")
        labels = self.points.select(F.col("id").alias("neighbour_id"), "label")
        votes = vote(found, labels, "_query", self.getOrDefault("classes"), self.getOrDefault("weights"))
        joined = query.join(votes.withColumnsRenamed({"scores": "_scores", "prediction": "_vote"}), "_query")
        return self._finish(joined.drop("_query"), F.col("_vote")).drop("_vote")

    def _finish(self, scored: DataFrame, prediction) -> DataFrame:
        return (
            scored.withColumn(self.getPredictionCol(), prediction)
            .withColumn(self.getProbabilityCol(), array_to_vector(F.col("_scores")))
            .drop("_scores")
        )

    def write(self) -> MLWriter:
        return _KNNWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KNNReader()


class _KNNWriter(MLWriter):
    def __init__(self, model: KNNModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.points.write.parquet(f"{path}/points")


class _KNNReader(MLReader):
    def load(self, path: str) -> KNNModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = KNNModel(spark.read.parquet(f"{path}/points"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
