"""The sigmoid map against the kernel."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tabwright.models.build import TrainFacts, build_model, scored_columns
from tabwright.models.kernel import KernelMap
from tabwright.operators.metrics import evaluate


def frame(spark, x, y):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", label double").repartition(4, "id")
    return VectorAssembler(inputCols=[f"x{j}" for j in range(x.shape[1])], outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(180, 3))
    y = np.sin(1.5 * x[:, 0]) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=180)
    y[:6] += 4  # far off
    return x, y, frame(spark, x, y)


def test_sigmoid_map_is_the_clipped_kernel(points):
    x, _, df = points
    model = KernelMap(inputCol="features", outputCol="m", kernel="sigmoid", gamma="0.3").fit(df)
    assert len(model.sampled_rows()) == 180  # all distinct rows, as they are few
    exact = np.tanh(0.3 * x @ x.T)
    values, vectors = np.linalg.eigh(exact)
    clipped = (vectors * np.maximum(values, 0)) @ vectors.T
    m = np.stack([r["m"].toArray() for r in model.transform(df).orderBy("id").select("m").collect()])
    assert np.abs(m @ m.T - clipped).max() < 1e-5
    # What clipping leaves out is all that is lost, and it is told.
    assert model.error() == pytest.approx(np.linalg.norm(exact - clipped) / np.linalg.norm(exact), rel=1e-3) and model.error() < 0.2


def test_landmarks_are_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr("tabwright.models.kernel.LANDMARKS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2)) * 0.6
    x[200:400] = x[0]
    df = frame(spark, x, np.zeros(600))
    one, two = (KernelMap(inputCol="features", outputCol="m", kernel="sigmoid", gamma="0.4").fit(d) for d in (df, df.repartition(7)))
    assert (one.sampled_rows() == two.sampled_rows()).all() and len({tuple(r) for r in one.sampled_rows()}) == 40
    m = np.stack([r["m"].toArray() for r in one.transform(df).orderBy("id").select("m").collect()])
    values, vectors = np.linalg.eigh(np.tanh(0.4 * x @ x.T))
    clipped = (vectors * np.maximum(values, 0)) @ vectors.T  # of all rows
    assert np.linalg.norm(m @ m.T - clipped) < 0.05 * np.linalg.norm(clipped)


def test_sigmoid_classifier_learns(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 240)
    df = frame(spark, np.where(y[:, None] > 0, 1.0, -1.0) + rng.normal(size=(240, 2)) * 0.6, y)
    facts = TrainFacts.of(df, "classification")
    fitted = build_model("SVC", "classification", {"kernel": "sigmoid", "gamma": "auto"}, facts).fit(df)
    assert evaluate(scored_columns(fitted.transform(df)), "classification", 2)["accuracy"] > 0.9
