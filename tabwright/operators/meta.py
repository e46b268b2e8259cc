"""Meta-features of a table, its difficulty score and the models to try first."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double, numeric_columns, ref, require_columns
from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.small import local_frame
from tabwright.models.catalog import list_models
from tabwright.operators.profile import Facts, Spread, column_facts, correlation_pairs

FENCE = 1.5
META_SCHEMA = (
    "n_samples bigint, n_features bigint, n_numerical bigint, n_categorical bigint, missing_ratio double, "
    "class_imbalance_ratio double, mean_correlation double, outlier_ratio double"
)


def missing_ratio(facts: Facts, features: list[str]) -> float:
    return sum(facts.missing[c] for c in features) / max(facts.rows * len(features), 1)


def class_imbalance(df: DataFrame, target: str) -> float:
    """Largest over smallest class count; null counts as a class, but not towards having two."""
    counts = df.groupBy(ref(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.count("v").alias("values"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    return row["most"] / row["least"] if row["values"] > 1 else 1.0


def mean_correlation(df: DataFrame, spreads: dict[str, Spread]) -> float:
    """Mean of the absolute correlation matrix with a zero diagonal, diagonal cells included."""
    if len(spreads) < 2:
        return 0.0
    total = correlation_pairs(df, list(spreads), spreads).agg(F.sum(F.abs("corr"))).first()[0]
    return 2 * total / len(spreads) ** 2


def outlier_ratio(df: DataFrame, columns: list[str]) -> float:
    """Share of complete rows with any value outside the fences; a column without spread has none."""
    if not columns:
        return 0.0
    complete = df.select(*[as_double(c).alias(c) for c in columns]).na.drop()
    quartiles = exact_quantiles(complete, columns, (0.25, 0.75))
    outside = []
    for c in columns:
        low, high = quartiles[c]
        if low is None or high == low:
            continue
        reach = FENCE * (high - low)
        outside.append((ref(c) < F.lit(low - reach)) | (ref(c) > F.lit(high + reach)))
    if not outside:
        return 0.0
    return complete.agg(F.avg(reduce(or_, outside).cast("double"))).first()[0] or 0.0


def meta_features(df: DataFrame, target: str) -> DataFrame:
    """One row of meta-features with the difficulty score in 0..1."""
    require_columns(df, target)
    features = [c for c in df.columns if c != target]
    numbers = numeric_columns(df, skip=[target])
    facts = column_facts(df)
    spreads = {c: s for c, s in facts.spreads().items() if c in numbers}
    row = (
        facts.rows,
        len(features),
        len(numbers),
        len(features) - len(numbers),
        missing_ratio(facts, features),
        float(class_imbalance(df, target)),
        float(mean_correlation(df, spreads)),
        float(outlier_ratio(df, numbers)),
    )
    return with_difficulty(local_frame(df.sparkSession, [row], META_SCHEMA))


def with_difficulty(meta: DataFrame) -> DataFrame:
    """Add ``difficulty_score``: five terms of equal weight, each held to at most 1."""
    one = F.lit(1.0)
    terms = [
        one - F.least(F.col("n_samples") / 10_000, one),
        F.least(F.col("n_features") / F.greatest(F.col("n_samples"), F.lit(1)) * 10, one),
        F.least(F.col("missing_ratio") * 4, one),
        F.least((F.col("class_imbalance_ratio") - 1) / 10, one),
        F.least(F.col("outlier_ratio") * 3, one),
    ]
    score = sum((t * 0.2 for t in terms), F.lit(0.0))
    return meta.withColumn("difficulty_score", F.least(F.greatest(score, F.lit(0.0)), one))


# Models tried first on hard, small and other tables.
FIRST_CHOICES = {
    "classification": {
        "hard": ["XGBClassifier", "LGBMClassifier", "RandomForestClassifier"],
        "small": ["LogisticRegression", "RandomForestClassifier", "SVC"],
        "other": ["RandomForestClassifier", "LGBMClassifier", "GradientBoostingClassifier"],
    },
    "regression": {
        "hard": ["XGBRegressor", "LGBMRegressor", "RandomForestRegressor"],
        "small": ["Ridge", "Lasso", "RandomForestRegressor"],
        "other": ["RandomForestRegressor", "LGBMRegressor", "GradientBoostingRegressor"],
    },
}
HARD_SCORE = 0.6
SMALL_ROWS = 1000


def recommend_frame(meta: DataFrame, task: str, top_k: int = 5) -> DataFrame:
    """``(seq, model)`` for a row of meta-features: first choices, then the rest by name."""
    choice = {kind: F.array(*map(F.lit, names)) for kind, names in FIRST_CHOICES[task].items()}
    first = (
        F.when(F.col("difficulty_score") >= HARD_SCORE, choice["hard"])
        .when(F.col("n_samples") < SMALL_ROWS, choice["small"])
        .otherwise(choice["other"])
    )
    rest = F.array(*map(F.lit, list_models(task)))
    ordered = F.slice(F.array_distinct(F.concat(first, rest)), 1, top_k)
    return meta.select(F.posexplode(ordered).alias("seq", "model")).withColumn("seq", F.col("seq") + 1)


def recommend(df: DataFrame, target: str, task: str, top_k: int = 5) -> list[str]:
    picks = recommend_frame(meta_features(df, target), task, top_k)
    return [r["model"] for r in picks.orderBy("seq").collect()]


def resolve_models(df: DataFrame, target: str, task: str, chosen: list[str] | None) -> list[str]:
    """The user's list if given, else the recommendation."""
    if not chosen:
        return recommend(df, target, task)
    known = list_models(task)
    unknown = [m for m in chosen if m not in known]
    if unknown:
        raise ValueError(f"unknown {task} models {', '.join(unknown)}; known are {', '.join(known)}")
    return list(chosen)
