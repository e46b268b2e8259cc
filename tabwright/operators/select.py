"""Feature selection: constant columns, mutual information, recursive elimination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import as_double, ref
from tabwright.functions.quantiles import exact_medians, exact_quantiles
from tabwright.functions.small import spread
from tabwright.operators.encode import label_encode, target_indexer, target_labels, text_columns
from tabwright.operators.information import neighbour_information
from tabwright.session import materialise

# Default number of features kept, and the forest of the elimination.
DEFAULT_K = 20
FOREST_TREES = 100
SEED = 42

INFORMATION_BINS = 16


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose codes vary. Text counts null as one more value, numbers skip it."""
    text = set(text_columns(df))
    tests = []
    for i, c in enumerate(columns):
        value = ref(c) if c in text else as_double(c)
        differs = F.min(value) < F.max(value)
        if c in text:
            differs = differs | ((F.count(value) > 0) & (F.count(value) < F.count(F.lit(1))))
        tests.append(F.coalesce(differs, F.lit(False)).alias(f"v{i}"))
    row = df.agg(*tests).first()
    return [c for i, c in enumerate(columns) if row[i]]


def _bins(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Quantile bin of each column as an integer; null has the bin -1."""
    probs = [i / INFORMATION_BINS for i in range(1, INFORMATION_BINS)]
    edges = exact_quantiles(df, columns, probs)
    result = {}
    for c in columns:
        cuts = sorted({e for e in edges[c] if e is not None})
        place = sum(((as_double(c) > F.lit(e)).cast("int") for e in cuts), F.lit(0))
        result[c] = F.when(ref(c).isNull(), F.lit(-1)).otherwise(place)
    return result


def mutual_information(df: DataFrame, target: str, columns: Sequence[str], task: str) -> DataFrame:
    """``(feature, mi)`` in nats between each binned feature and the target.

    Text is coded first and binned like a number. A regression target is binned as well. The
    counts of all features come from one shuffle whose size is features x bins x classes.
    """
    columns = list(columns)
    coded = label_encode(df.where(ref(target).isNotNull()), [c for c in text_columns(df) if c in columns])
    binned = _bins(coded, columns if task == "classification" else list(dict.fromkeys([*columns, target])))
    goal = (ref(target) if task == "classification" else binned[target]).cast("string")
    cells = (
        coded.select(goal.alias("_class"), *[binned[c].alias(c) for c in columns])
        .unpivot(["_class"], [ref(c) for c in columns], "feature", "bin")
        .groupBy("feature", "bin", "_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by = lambda *keys: Window.partitionBy(*keys)
    with_sums = cells.select(
        "feature",
        "n",
        F.sum("n").over(by("feature")).alias("total"),
        F.sum("n").over(by("feature", "bin")).alias("n_bin"),
        F.sum("n").over(by("feature", "_class")).alias("n_class"),
    )
    term = F.col("n") / F.col("total") * F.ln(
        F.col("n").cast("double") * F.col("total") / (F.col("n_bin").cast("double") * F.col("n_class"))
    )
    return with_sums.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def forest_elimination(df: DataFrame, target: str, columns: Sequence[str], k: int, task: str, step: int = 1) -> list[str]:
    """Refit a forest and drop the ``step`` weakest features until ``k`` are left."""
    columns = list(columns)
    coded = label_encode(df.where(ref(target).isNotNull()), [c for c in text_columns(df) if c in columns])
    medians = exact_medians(coded, columns)
    safe = {c: f"x{i}" for i, c in enumerate(columns)}
    filled = coded.select(
        ref(target), *[F.coalesce(as_double(c), F.lit(medians[c] or 0.0)).alias(safe[c]) for c in columns]
    )
    options = {"numTrees": FOREST_TREES, "seed": SEED, "featuresCol": "features", "labelCol": "label"}
    if task == "classification":
        filled = target_indexer(target_labels(df, target), target).transform(filled)
        forest = RandomForestClassifier(**options)
    else:
        filled = filled.withColumn("label", as_double(target))
        forest = RandomForestRegressor(featureSubsetStrategy="all", **options)
    # The forest holds the number of draws of each row for every tree, so a task must not have many rows.
    filled = materialise(spread(filled.select("label", *safe.values())))
    left = list(columns)
    while len(left) > k:
        vectors = VectorAssembler(inputCols=[safe[c] for c in left], outputCol="features").transform(filled)
        weights = forest.fit(vectors.select("label", "features")).featureImportances.toArray()
        drop = sorted(range(len(left)), key=lambda i: (weights[i], -i))[: min(step, len(left) - k)]
        left = [c for i, c in enumerate(left) if i not in set(drop)]
    return left


def clamp_k(k: int | None, features: int) -> int:
    wanted = min(DEFAULT_K, features) if k is None else int(k)
    return max(1, min(wanted, features))


def select_features(
    df: DataFrame, target: str, method: str = "variance_threshold", k: int | None = None, task: str = "classification"
) -> list[str]:
    """Names of the chosen features in table order; fewer than two features are all kept.

    ``mutual_information`` measures by nearest neighbours, ``binned_information`` by quantile bins, which is cheaper.
    """
    columns = [c for c in df.columns if c != target]
    if len(columns) < 2:
        return columns
    k = clamp_k(k, len(columns))
    if method == "variance_threshold":
        return varying_columns(df, columns)
    if method in ("mutual_information", "binned_information"):
        measure = neighbour_information if method == "mutual_information" else mutual_information
        best = measure(df, target, columns, task).orderBy(F.desc("mi"), "feature").limit(k)
        chosen = {r["feature"] for r in best.collect()}
        return [c for c in columns if c in chosen]
    if method == "recursive_feature_elimination":
        return forest_elimination(df, target, columns, k, task)
    return columns[:k]
