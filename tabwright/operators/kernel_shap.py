"""Model-free Shapley values (Lundberg, Lee 2017) as one scored and aggregated frame.

All rows share the same coalitions, so the weighted least squares fit is one fixed linear map of
the coalition values. Its coefficients ride along with the coalitions and the fit becomes sums.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.small import local_frame, task_count

SEED = 42
EXTRA_COALITIONS = 2048


def coalition_masks(features: int, limit: int | None = None, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Masks and kernel weights: all coalitions if they fit the limit, else seeded draws in opposite pairs."""
    limit = limit or 2 * features + EXTRA_COALITIONS
    sizes = np.arange(1, features)
    if 2**features - 2 <= limit:
        masks, weights = [], []
        for size in sizes:
            for chosen in combinations(range(features), int(size)):
                mask = np.zeros(features, dtype=bool)
                mask[list(chosen)] = True
                masks.append(mask)
                weights.append((features - 1) / (math.comb(features, int(size)) * size * (features - size)))
        return np.array(masks), np.array(weights)
    rng = np.random.default_rng(seed)
    chance = 1.0 / (sizes * (features - sizes))
    counts: dict[bytes, int] = {}
    for size in rng.choice(sizes, size=limit // 2, p=chance / chance.sum()):
        mask = np.zeros(features, dtype=bool)
        mask[rng.choice(features, size=size, replace=False)] = True
        for m in (mask, ~mask):
            counts[m.tobytes()] = counts.get(m.tobytes(), 0) + 1
    masks = np.array([np.frombuffer(k, dtype=bool) for k in counts])
    return masks, np.array(list(counts.values()), dtype=float)


def fit_map(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix that turns centred coalition values into all Shapley values but the last."""
    x = masks[:, :-1].astype(float) - masks[:, -1:].astype(float)
    weighted = x * weights[:, None]
    return np.linalg.lstsq(x.T @ weighted, weighted.T, rcond=None)[0]


def _outputs(model: Model, scored: DataFrame) -> Column:
    """What is explained: class probabilities if the model has them, else the prediction."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    return F.array(F.col("prediction"))


def kernel_shap(
    df: DataFrame,
    model: Model,
    background: DataFrame,
    key: str,
    features: str = "features",
    coalitions: int | None = None,
    output: str = "shap",
) -> DataFrame:
    """``(key, base, output)`` with an array per feature of arrays per model output.

    ``background`` should be small, about a hundred rows: each row of ``df`` is scored once per
    coalition and background row. ``key`` must identify the rows of ``df``.
    """
    spark = df.sparkSession
    known = background.select(vector_to_array(F.col(features)).alias("b")).collect()
    size = len(known[0]["b"])
    base_rows = model.transform(background.select(features))
    base = np.array(
        base_rows.select(_outputs(model, base_rows).alias("o")).agg(
            F.array(*[F.avg(F.get("o", F.lit(k))) for k in range(_width(model, base_rows))]).alias("m")
        ).first()["m"]
    )
    # Partitioned by key before each row is blown up, so the sums per row need no further shuffle.
    rows = df.select(F.col(key).alias("_key"), vector_to_array(F.col(features)).alias("x")).repartition(
        task_count(spark), "_key"
    )
    if size == 1:
        masks, solve = np.zeros((0, 1), dtype=bool), np.zeros((0, 0))
    else:
        masks, weights = coalition_masks(size, coalitions)
        solve = fit_map(masks, weights)
    full = len(masks)
    plan = [(c, [bool(v) for v in m], [float(v) / len(known) for v in solve[:, c]]) for c, m in enumerate(masks)]
    plan.append((full, [True] * size, [0.0] * (size - 1)))
    coalition_frame = local_frame(spark, plan, "c int, mask array<boolean>, w array<double>")
    background_frame = local_frame(spark, [(i, r["b"]) for i, r in enumerate(known)], "b_id int, b array<double>")
    # The full coalition equals the row itself and needs no background.
    last_background = F.when(F.col("c") == full, 0).otherwise(len(known) - 1)
    mixed = (
        rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(full))))
        .withColumn("b_id", F.explode(F.sequence(F.lit(0), last_background)))
        .join(F.broadcast(coalition_frame), "c")
        .join(F.broadcast(background_frame), "b_id")
    )
    blend = F.zip_with(
        F.arrays_zip("mask", "x"), F.col("b"), lambda own, other: F.when(own["mask"], own["x"]).otherwise(other)
    )
    scored = model.transform(mixed.select("_key", "c", "w", array_to_vector(blend).alias(features)))
    width = len(base)
    scored = scored.select("_key", "c", "w", _outputs(model, scored).alias("o"))
    sums = [
        F.sum(F.get("w", F.lit(j)) * F.get("o", F.lit(k))).alias(f"s_{j}_{k}")
        for j in range(size - 1)
        for k in range(width)
    ]
    own = [F.max(F.when(F.col("c") == full, F.get("o", F.lit(k)))).alias(f"f_{k}") for k in range(width)]
    fitted = scored.groupBy("_key").agg(*sums, *own)
    total = solve.sum(axis=1) if full else np.zeros(0)
    last = solve @ masks[:, -1].astype(float) if full else np.zeros(0)
    gain = [F.col(f"f_{k}") - F.lit(float(base[k])) for k in range(width)]
    values = [
        [
            F.col(f"s_{j}_{k}") - F.lit(float(base[k] * total[j])) - F.lit(float(last[j])) * gain[k]
            for k in range(width)
        ]
        for j in range(size - 1)
    ]
    rest = [gain[k] - sum((values[j][k] for j in range(size - 1)), F.lit(0.0)) for k in range(width)]
    return fitted.select(
        F.col("_key").alias(key),
        F.array(*[F.lit(float(v)) for v in base]).alias("base"),
        F.array(*[F.array(*v) for v in [*values, rest]]).alias(output),
    )


def _width(model: Model, scored: DataFrame) -> int:
    if "probability" not in scored.columns:
        return 1
    return len(scored.select("probability").first()["probability"])
