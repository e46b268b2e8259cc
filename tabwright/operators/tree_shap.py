"""Shapley values of tree ensembles, path dependent as in TreeSHAP (Lundberg et al. 2020).

For one leaf let feature ``j`` on its path be met with chance ``z`` when unknown and met or not
(``o`` = 1 or 0) when known. The leaf's part of the Shapley value is the leaf value times
``(o_j - z_j)`` times the integral over ``t`` of the product of ``z_i (1 - t) + o_i t`` over the
other features. That is a polynomial, which Gauss-Legendre quadrature integrates exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, functions as F

from tabwright.models.boosting import BoostedTreesModel
from tabwright.session import scratch_path

TREE_MODELS = (
    RandomForestClassificationModel,
    RandomForestRegressionModel,
    GBTClassificationModel,
    GBTRegressionModel,
    BoostedTreesModel,
)
ROW_CHUNK = 512


# Leaves with the same number of path features, one row per leaf and one column per feature:
# feature numbers, lower and upper bounds, chances, and the leaf values per output.
Leaves = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def read_nodes(model: Model, spark) -> dict[int, dict[int, dict]]:
    """Nodes of every tree, through the model's saved form."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return trees


def leaf_tables(model: Model, spark) -> tuple[list[Leaves], int, np.ndarray]:
    """Leaf tables by path length, number of outputs, and the expected output over the training rows."""
    if isinstance(model, BoostedTreesModel):
        return boosted_tables(model)[:3]
    trees = read_nodes(model, spark)
    classifies = isinstance(model, RandomForestClassificationModel)
    if classifies or isinstance(model, RandomForestRegressionModel):
        shares = {t: 1.0 / len(trees) for t in trees}
    else:
        shares = dict(enumerate(model.treeWeights))
    outputs = model.numClasses if classifies else 1
    found: dict[int, list[tuple]] = {}
    expected = np.zeros(outputs)

    def weight(node) -> float:
        stats = node["impurityStats"]
        return sum(stats) if classifies else stats[0]

    for tree, nodes in trees.items():
        stack = [(nodes[0], {})]
        while stack:
            node, path = stack.pop()
            if node["leftChild"] < 0:
                value = np.array(node["impurityStats"]) / weight(node) if classifies else np.array([node["prediction"]])
                value = value * shares[tree]
                found.setdefault(len(path), []).append((path, value))
                expected += value * np.prod([p[2] for p in path.values()])
                continue
            split = node["split"]
            feature, cut, flip = split["featureIndex"], 0.5, False
            if split["numCategories"] == -1:
                cut = split["leftCategoriesOrThreshold"][0]
            elif split["numCategories"] == 2:
                flip = list(split["leftCategoriesOrThreshold"]) == [1.0]
            else:
                raise ValueError("only yes/no categories can be explained")
            for child, below in ((node["leftChild"], not flip), (node["rightChild"], flip)):
                low, high, chance = path.get(feature, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, cut)) if below else (max(low, cut), high)
                reached = nodes[child]
                share = weight(reached) / weight(node)
                stack.append((reached, {**path, feature: (low, high, chance * share)}))
    tables = []
    for size, leaves in sorted(found.items()):
        if size:
            pick = lambda i: np.array([[p[i] for p in path.values()] for path, _ in leaves])
            tables.append(
                (
                    np.array([list(path) for path, _ in leaves]),
                    pick(0),
                    pick(1),
                    pick(2),
                    np.array([value for _, value in leaves]),
                )
            )
    return tables, outputs, expected


def boosted_tables(model: BoostedTreesModel) -> tuple[list[Leaves], int, np.ndarray, list[np.ndarray]]:
    """As ``leaf_tables``, for margins, and per table whether a missing value of each path feature reaches the leaf."""
    outputs, expected = len(model.start), np.array(model.start, float)
    found: dict[int, list[tuple]] = {}
    for trees in model.forest:
        for k, tree in enumerate(trees):
            stack = [(0, {})]
            while stack:
                node, path = stack.pop()
                if tree["left"][node] < 0:
                    value = np.zeros(outputs)
                    value[k] = tree["value"][node]
                    found.setdefault(len(path), []).append((path, value))
                    expected += value * np.prod([p[2] for p in path.values()])
                    continue
                feature, cut, to_left = int(tree["feature"][node]), tree["cut"][node], tree["missing_left"][node]
                for child, below in ((tree["left"][node], True), (tree["right"][node], False)):
                    low, high, chance, missing = path.get(feature, (-np.inf, np.inf, 1.0, True))
                    low, high = (low, min(high, cut)) if below else (max(low, cut), high)
                    share = tree["rows"][child] / tree["rows"][node]
                    stack.append((child, {**path, feature: (low, high, chance * share, missing and to_left == below)}))
    tables, open_to_missing = [], []
    for size, leaves in sorted(found.items()):
        if size:
            parts = [np.array([[p[i] for p in path.values()] for path, _ in leaves]) for i in range(4)]
            tables.append((np.array([list(path) for path, _ in leaves]), *parts[:3], np.array([value for _, value in leaves])))
            open_to_missing.append(parts[3])
    return tables, outputs, expected, open_to_missing


def shapley_rows(x: np.ndarray, tables: list[Leaves], outputs: int, open_to_missing: list[np.ndarray] | None = None) -> np.ndarray:
    """Shapley values as rows x features x outputs."""
    phi = np.zeros((x.shape[1], len(x), outputs))
    for n, table in enumerate(tables):
        size = table[0].shape[1]
        missing = open_to_missing[n] if open_to_missing else np.zeros(table[0].shape, bool)
        points, weights = np.polynomial.legendre.leggauss((size + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        for feature, low, high, chance, value, passes in zip(*table, missing):
            at = x[:, feature]
            met = np.where(np.isnan(at), passes, (at > low) & (at <= high)).astype(float)
            terms = chance[None, :, None] * (1 - points) + met[:, :, None] * points
            whole = terms.prod(axis=1)
            part = (met - chance) * ((whole * weights)[:, None, :] / terms).sum(axis=2)
            for j, f in enumerate(feature):
                phi[f] += part[:, j, None] * value
    return phi.transpose(1, 0, 2)


def tree_shap(df: DataFrame, model: Model, features: str = "features", output: str = "shap") -> DataFrame:
    """Add ``output``: an array per feature of arrays per model output. Boosted margins are explained, not chances."""
    spark = df.sparkSession
    if isinstance(model, BoostedTreesModel):
        tables, outputs, _, missing = boosted_tables(model)
    else:
        (tables, outputs, _), missing = leaf_tables(model, spark), None
    shared = spark.sparkContext.broadcast((tables, missing))

    @F.pandas_udf("array<array<double>>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for start in range(0, len(batch), ROW_CHUNK):
                x = np.stack(batch.iloc[start : start + ROW_CHUNK].to_numpy())
                rows += [[list(f) for f in r] for r in shapley_rows(x, shared.value[0], outputs, shared.value[1])]
            yield pd.Series(rows)

    return df.withColumn(output, explain(vector_to_array(F.col(features))))

