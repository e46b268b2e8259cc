"""Isolation forest (Liu, Ting, Zhou 2008): trees grown from small samples, rows scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import as_double
from tabwright.functions.quantiles import exact_medians, exact_quantiles
from tabwright.functions.small import task_count
from tabwright.session import materialise

# Size of the forest, of one tree's sample, and the seed.
TREES = 200
TREE_ROWS = 256
SEED = 42

POOL_ROWS = TREES * TREE_ROWS
TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"


def _uniform(key: Sequence[str] | None, seed: int, *extra: Column) -> Column:
    """Uniform number per row: from the row key if there is one, else from Spark's generator."""
    if not key:
        return F.rand(seed)
    span = 1 << 31
    return F.pmod(F.xxhash64(F.lit(seed), *extra, *[F.col(k) for k in key]), F.lit(span)) / F.lit(float(span))


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """One random tree over at most ``TREE_ROWS`` rows, as parallel node arrays."""
    tree = int(pdf["tree"].iloc[0])
    points = pdf.sort_values("_u", kind="stable").drop(columns=["tree", "_u"]).to_numpy(dtype=float)
    rng = np.random.default_rng([SEED, tree])
    limit = math.ceil(math.log2(max(len(points), 2)))
    feature, cut, left, right, length = [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        node = len(feature)
        feature.append(-1)
        cut.append(0.0)
        left.append(node)
        right.append(node)
        length.append(depth + _average_path(len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or varied.size == 0:
            return node
        f = int(rng.choice(varied))
        at = rng.uniform(low[f], high[f])
        smaller = rows[:, f] <= at
        feature[node], cut[node] = f, at
        left[node] = grow(rows[smaller], depth + 1)
        right[node] = grow(rows[~smaller], depth + 1)
        return node

    grow(points, 0)
    return pd.DataFrame(
        {"tree": [tree], "feature": [feature], "cut": [cut], "left": [left], "right": [right], "length": [length]}
    )


def fit_forest(df: DataFrame, filled: Sequence[Column], key: Sequence[str] | None = None) -> list:
    """The trees as rows; at most ``TREES`` rows of at most ``2 * TREE_ROWS`` nodes each."""
    values = [v.alias(f"x{i}") for i, v in enumerate(filled)]
    rows = df.count()
    share = min(1.0, 1.2 * POOL_ROWS / max(rows, 1))
    pool = df.select(*values, _uniform(key, SEED).alias("_p"), *([F.struct(*key).alias("_k")] if key else []))
    # The pool is small but each of its rows is drawn for every tree, so it is spread evenly first.
    tasks = min(task_count(df.sparkSession), TREES)
    pool = materialise(pool.where(F.col("_p") < share).repartition(tasks))
    size = max(pool.count(), 1)
    draws = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn(
        "_u", _uniform(["_k"] if key else None, SEED + 1, F.col("tree"))
    )
    draws = draws.where(F.col("_u") < min(1.0, 2.0 * TREE_ROWS / size)).drop("_p", "_k").repartition(tasks, "tree")
    order = Window.partitionBy("tree").orderBy("_u")
    sample = draws.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= TREE_ROWS).drop("_n")
    return sample.groupBy("tree").applyInPandas(grow_tree, TREE_SCHEMA).orderBy("tree").collect()


def score_column(df: DataFrame, filled: Sequence[Column], trees: list) -> Column:
    """Anomaly score in 0..1; larger is stranger."""
    forest = [
        tuple(np.asarray(t[c]) for c in ("feature", "cut", "left", "right", "length")) for t in trees
    ]
    scale = _average_path(TREE_ROWS)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, left, right, length in shared.value:
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    split = feature[node]
                    if (split < 0).all():
                        break
                    smaller = x[rows, np.maximum(split, 0)] <= cut[node]
                    node = np.where(split < 0, node, np.where(smaller, left[node], right[node]))
                total += length[node]
            yield pd.Series(np.exp2(-total / (len(shared.value) * scale)))

    return score(*filled)


def isolation_filter(
    df: DataFrame,
    columns: Sequence[str],
    contamination: float,
    key: Sequence[str] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Keep all rows but the ``contamination`` share with the largest scores; nulls count as the median."""
    source = df if fit_on is None else fit_on
    medians = exact_medians(source, columns)
    used = [c for c in columns if medians[c] is not None]
    if not used:
        return df
    filled = [F.coalesce(as_double(c), F.lit(medians[c])) for c in used]
    trees = fit_forest(source, filled, key)
    scores = materialise(source.select(score_column(source, filled, trees).alias("score")))
    limit = exact_quantiles(scores, ["score"], [1.0 - contamination])["score"][0]
    return df.withColumn("_score", score_column(df, filled, trees)).where(F.col("_score") <= F.lit(limit)).drop("_score")
