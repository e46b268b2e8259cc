"""Profile of one table: shape, roles, missing values, duplicates, statistics, correlation, classes."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabwright.functions.columns import (
    as_double,
    column_roles,
    numeric_columns,
    ref,
    require_columns,
    rows_from_wide,
)
from tabwright.functions.counting import top_values, value_counts
from tabwright.functions.ordering import ORDER, order_hash, rank_cuts
from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.small import local_frame
from tabwright.session import materialise

# Limits of the task rule, of the bounded sample and of the charts.
CLASS_LIMIT = 20
CLASS_SHARE = 0.05
SAMPLE_ROWS = 10_000
SAMPLE_SEED = 42
CHART_COLUMNS = 12

DUPLICATE_HASHES = 1_000_000
QUARTILES = (0.25, 0.5, 0.75)
CLASS_LEVELS_SHOWN = 10_000


def dtypes_frame(df: DataFrame) -> DataFrame:
    return local_frame(df.sparkSession, df.dtypes, "column string, dtype string")


def problem_type_frame(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, distinct target values and the task they point to."""
    require_columns(df, target)
    numbers = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(ref(target)).alias("n_values"))
    if not isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType)):
        return numbers.withColumn("problem_type", F.lit("classification"))
    share = F.col("n_values") / F.greatest(F.col("n_rows"), F.lit(1))
    few = (F.col("n_values") <= CLASS_LIMIT) | (share < CLASS_SHARE)
    return numbers.withColumn("problem_type", F.when(few, "classification").otherwise("regression"))


def problem_type(df: DataFrame, target: str, override: str | None = None) -> str:
    if override in ("classification", "regression"):
        return override
    require_columns(df, target)
    if not isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType)):
        return "classification"
    return problem_type_frame(df, target).first()["problem_type"]


def overview(df: DataFrame, target: str) -> DataFrame:
    """Row, column and role counts."""
    require_columns(df, target)
    roles = column_roles(df, target)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.lit(len(df.columns) - 1).cast("bigint").alias("n_features"),
        F.lit(len(roles.numerical)).cast("bigint").alias("n_numerical"),
        F.lit(len(roles.categorical)).cast("bigint").alias("n_categorical"),
    )


def _null_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing count and percentage of the columns that miss anything, worst first."""
    pct = lambda i: F.round(F.col(f"m{i}") / F.greatest(F.col("n"), F.lit(1)) * 100, 4)
    rows = [(F.lit(c), F.col(f"m{i}"), pct(i)) for i, c in enumerate(df.columns)]
    table = rows_from_wide(_null_counts(df), ("column", "missing_count", "missing_pct"), rows)
    return table.where("missing_count > 0").orderBy(F.desc("missing_pct"), "column")


def missing_totals(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table and their percentage of all cells."""
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("bigint"))
    cells = F.greatest(F.col("n") * len(df.columns), F.lit(1))
    return _null_counts(df).select(total.alias("total_missing"), (total / cells * 100).alias("missing_pct"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier row; nulls compare equal.

    Rows are first counted by a 64-bit hash, which shuffles eight bytes a row. Only rows whose
    hash occurs again are then grouped by their full content, so the count is exact.
    """
    rows = df.select(*[ref(c) for c in columns]) if columns else df
    hashed = rows.withColumn("_hash", F.xxhash64(*[ref(c) for c in rows.columns]))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    repeated = materialise(repeated)
    if repeated.count() <= DUPLICATE_HASHES:  # eight bytes each
        repeated = F.broadcast(repeated)
    suspects = hashed.join(repeated, "_hash", "left_semi")
    copies = suspects.groupBy(*[ref(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, stat, value)`` for numeric columns: count, mean, sample std, min, quartiles, max."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, QUARTILES)
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        value = as_double(c)
        aggregates += [
            F.count(value).alias(f"c{i}"),
            F.avg(value).alias(f"a{i}"),
            F.stddev_samp(value).alias(f"s{i}"),
            F.min(value).alias(f"l{i}"),
            F.max(value).alias(f"h{i}"),
        ]
        stats = [("count", F.col(f"c{i}")), ("mean", F.col(f"a{i}")), ("std", F.col(f"s{i}")), ("min", F.col(f"l{i}"))]
        stats += [(f"{p:.0%}", F.lit(q)) for p, q in zip(QUARTILES, quartiles[c])]
        stats += [("max", F.col(f"h{i}"))]
        rows += [(F.lit(c), F.lit(s), F.round(F.coalesce(v.cast("double"), F.lit(0.0)), 4)) for s, v in stats]
    return rows_from_wide(df.agg(*aggregates), ("column", "stat", "value"), rows)


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, unique, top, freq)`` for the columns that are not numbers."""
    if columns is None:
        numbers = set(numeric_columns(df))
        columns = [c for c in df.columns if c not in numbers]
    found = top_values(value_counts(df, columns))
    named = local_frame(df.sparkSession, [(c,) for c in columns], "column string")
    return named.join(found, "column", "left").select(
        "column",
        F.coalesce("total", F.lit(0)).alias("count"),
        F.coalesce("levels", F.lit(0)).alias("unique"),
        F.coalesce("top", F.lit("0")).alias("top"),
        F.coalesce("freq", F.lit(0)).alias("freq"),
    )


@dataclass(frozen=True)
class Spread:
    """What one pass tells about a numeric column."""

    mean: float
    varies: bool


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


@dataclass(frozen=True)
class Facts:
    """Counts of all columns and moments of the numeric ones, from a single scan."""

    rows: int
    missing: dict[str, int]
    numbers: dict[str, dict[str, float]]

    def spreads(self) -> dict[str, Spread]:
        return {
            c: Spread(v["mean"] or 0.0, v["min"] is not None and v["min"] < v["max"]) for c, v in self.numbers.items()
        }


def column_facts(df: DataFrame) -> Facts:
    numbers = numeric_columns(df)
    aggregates = [F.count(F.lit(1)).alias("n")]
    aggregates += [F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    functions = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    for i, c in enumerate(numbers):
        aggregates += [f(as_double(c)).alias(f"{name}{i}") for name, f in functions.items()]
    row = df.agg(*aggregates).first()
    return Facts(
        row["n"],
        {c: row[f"m{i}"] for i, c in enumerate(df.columns)},
        {c: {name: row[f"{name}{i}"] for name in functions} for i, c in enumerate(numbers)},
    )


def column_spreads(df: DataFrame, columns: Sequence[str]) -> dict[str, Spread]:
    aggregates = []
    for i, c in enumerate(columns):
        value = as_double(c)
        aggregates += [F.avg(value).alias(f"a{i}"), (F.min(value) < F.max(value)).alias(f"v{i}")]
    row = df.agg(*aggregates).first()
    return {c: Spread(row[f"a{i}"] or 0.0, bool(row[f"v{i}"])) for i, c in enumerate(columns)}


SUM_NAMES = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]


def pair_sums(df: DataFrame, spreads: dict[str, Spread]) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)``: sums of deviations over the rows where both columns are present.

    Each task multiplies its Arrow batches as matrices, with a 0/1 matrix for the present values,
    and gives one row per pair of columns; the rows are then added up.
    """
    means = np.array([s.mean for s in spreads.values()])
    first, second = np.triu_indices(len(means), 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, len(means), len(means)))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = (~np.isnan(values)).astype(float)
            moved = np.where(there > 0, values - means, 0.0)
            totals += [there.T @ there, moved.T @ there, (moved * moved).T @ there, moved.T @ moved]
        n, single, square, product = totals
        sums = [
            n[first, second],
            single[first, second],
            single[second, first],
            square[first, second],
            square[second, first],
            product[first, second],
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(first.astype("int32")), pa.array(second.astype("int32")), *map(pa.array, sums)], names=SUM_NAMES
        )

    numbers = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(spreads)])
    partial = numbers.mapInArrow(products, "i int, j int, " + ", ".join(f"{s} double" for s in SUM_NAMES[2:]))
    return partial.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUM_NAMES[2:]])


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], spreads: dict[str, Spread] | None = None
) -> DataFrame:
    """``(col_a, col_b, corr)`` for each unordered pair, unrounded; 0 where it is not defined."""
    spreads = spreads or column_spreads(df, columns)
    names = F.array(*[F.lit(c) for c in spreads])
    varies = F.array(*[F.lit(s.varies) for s in spreads.values()])
    mean_of = lambda a, b: F.try_divide(F.col(a) * F.col(b), "n")
    alone = (F.col("xx") - mean_of("x", "x")) * (F.col("yy") - mean_of("y", "y"))
    both_vary = varies[F.col("i")] & varies[F.col("j")] & (alone > 0)
    corr = F.when(both_vary, F.try_divide(F.col("xy") - mean_of("x", "y"), F.sqrt(alone)))
    return pair_sums(df, spreads).select(
        names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), F.coalesce(corr, F.lit(0.0)).alias("corr")
    )


def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, spreads: dict[str, Spread] | None = None
) -> DataFrame:
    """Full correlation matrix as ``(col_a, col_b, corr)``, empty with fewer than two columns.

    The diagonal is 1, or 0 for a constant column.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return local_frame(df.sparkSession, [], "col_a string, col_b string, corr double")
    spreads = spreads or column_spreads(df, columns)
    pairs = correlation_pairs(df, columns, spreads)
    both = pairs.select(
        F.inline(
            F.array(
                F.struct("col_a", "col_b", "corr"),
                F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"),
            )
        )
    )
    diagonal = local_frame(
        df.sparkSession,
        [(c, c, float(spreads[c].varies)) for c in columns],
        "col_a string, col_b string, corr double",
    )
    return both.unionAll(diagonal).withColumn("corr", F.round("corr", 4))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Share of each non-null target value, largest first."""
    require_columns(df, target)
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select("class", "n", (F.col("n") / F.lit(total)).alias("share")).orderBy(F.desc("n"), "class")


def bounded_sample(df: DataFrame, rows: int, key: Sequence[str], seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly ``rows`` rows in the seeded hash order of ``key``, or the table if it is smaller."""
    hashed = df.withColumn(ORDER, order_hash(key, seed))
    size = df.count()
    if size <= rows:
        return df
    wanted = local_frame(df.sparkSession, [(0, rows)], "cut int, rank bigint")
    bound = rank_cuts(hashed.select(ORDER), wanted, rows=size).first()["bound"]
    return hashed.where(F.col(ORDER) <= F.lit(bound)).drop(ORDER)


def advice(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """``(seq, title, description, recommendation)`` drawn from rules over the profile."""
    task = task or problem_type(df, target)
    facts = missing_totals(df).first()
    rows = df.count()
    return local_frame(
        df.sparkSession,
        _advice_rows(facts["total_missing"], _class_span(df, target, task), rows, len(df.columns) - 1),
        "seq int, title string, description string, recommendation string",
    )


def _class_span(df: DataFrame, target: str, task: str) -> tuple[float, float] | None:
    if task != "classification":
        return None
    span = class_distribution(df, target).agg(F.min("share") * 100, F.max("share") * 100).first()
    return None if span[0] is None else (span[0], span[1])


# The texts of the exploration advice.
ADVICE = {
    "missing": (
        "Handle Missing Values",
        "Found {missing} missing values across columns.",
        "Consider median imputation for numerical features or mode for categorical. "
        "Enable feature-specific strategies in configuration.",
    ),
    "complete": (
        "No Missing Values Detected",
        "Your dataset is clean with no missing values.",
        "You can proceed directly to model training or enable data cleaning options for robustness.",
    ),
    "imbalance": (
        "Class Imbalance Detected",
        "Target class ranges from {low:.1f}% to {high:.1f}%.",
        "Consider enabling stratified cross-validation or adjusting evaluation metrics to F1-score "
        "for balanced assessment.",
    ),
    "balanced": (
        "Balanced Target Classes",
        "Classes are evenly distributed ({low:.1f}% – {high:.1f}%).",
        "Accuracy is a suitable primary metric. Proceed with standard training.",
    ),
    "small": (
        "Small Dataset",
        "Dataset has only {rows} rows.",
        "Use fewer CV folds (3–5) to preserve training data. "
        "Consider reducing the number of hyperparameter trials.",
    ),
    "large": (
        "Large Dataset",
        "Dataset has {rows:,} rows.",
        "Consider enabling sample-based training or parallel processing. GPU acceleration may be beneficial.",
    ),
    "wide": (
        "High Dimensionality",
        "Dataset has {features} features (excluding target).",
        "Enable feature selection in configuration to reduce noise and improve model interpretability.",
    ),
}
ADVICE_SPREAD = 50
ADVICE_FEW_ROWS = 100
ADVICE_MANY_ROWS = 100_000
ADVICE_MANY_FEATURES = 50


def _advice_rows(missing: int, span: tuple[float, float] | None, rows: int, features: int) -> list[tuple]:
    low, high = span or (0.0, 0.0)
    picked = ["missing" if missing > 0 else "complete"]
    if span:
        picked.append("imbalance" if high - low > ADVICE_SPREAD else "balanced")
    if rows < ADVICE_FEW_ROWS:
        picked.append("small")
    elif rows > ADVICE_MANY_ROWS:
        picked.append("large")
    if features > ADVICE_MANY_FEATURES:
        picked.append("wide")
    facts = {"missing": missing, "low": low, "high": high, "rows": rows, "features": features}
    return [
        (seq, ADVICE[k][0], ADVICE[k][1].format(**facts), ADVICE[k][2]) for seq, k in enumerate(picked, start=1)
    ]


def chart_missing(df: DataFrame) -> DataFrame:
    """The worst columns of the missing table, as many as a chart shows."""
    return missing_by_column(df).limit(CHART_COLUMNS).select("column", F.col("missing_count").alias("missing"))


def chart_classes(df: DataFrame, target: str) -> DataFrame:
    return class_distribution(df, target).select(
        F.col("class").cast("string").alias("label"), (F.col("share") * 100).alias("pct")
    )


def profile(
    df: DataFrame,
    target: str | None = None,
    sample_rows: int | None = None,
    key: Sequence[str] | None = None,
) -> dict:
    """The whole profile as one nested dict, ready for JSON.

    Statistics see every row unless ``sample_rows`` and a row ``key`` ask for the bounded sample.
    """
    target = target or df.columns[-1]
    require_columns(df, target)
    sampled = bool(sample_rows and key)
    facts = column_facts(df)
    seen = bounded_sample(df, sample_rows, key) if sampled else df
    seen_facts = column_facts(seen) if sampled else facts
    roles = column_roles(df, target)
    task = problem_type(seen, target)
    numbers = numeric_columns(df)
    texts = [c for c in df.columns if c not in set(numbers)]
    cells = max(facts.rows * len(df.columns), 1)
    missing = [
        {"column": c, "missing_count": m, "missing_pct": round(m / max(seen_facts.rows, 1) * 100, 4)}
        for c, m in seen_facts.missing.items()
        if m > 0
    ]
    quartiles = exact_quantiles(seen, numbers, QUARTILES)
    described: dict[str, dict] = {}
    for c in numbers:
        stats = {**seen_facts.numbers[c], **{f"{p:.0%}": q for p, q in zip(QUARTILES, quartiles[c])}}
        described[c] = {name: round(float(stats[name] or 0.0), 4) for name in STATS}
    if texts:
        for r in describe_text(seen, texts).collect():
            described[r["column"]] = {k: r[k] for k in ("count", "unique", "top", "freq")}
    matrix: dict[str, dict[str, float]] | None = None
    if len(numbers) > 1:
        matrix = {}
        for r in correlation(seen, numbers, seen_facts.spreads()).collect():
            matrix.setdefault(r["col_a"], {})[r["col_b"]] = r["corr"]
    result = {
        "n_rows": facts.rows,
        "n_cols": len(df.columns),
        "n_features": len(df.columns) - 1,
        "n_numerical": len(roles.numerical),
        "n_categorical": len(roles.categorical),
        "target": target,
        "problem_type": task,
        "feature_types": {"numerical": roles.numerical, "categorical": roles.categorical},
        "missing_info": sorted(missing, key=lambda m: (-m["missing_pct"], m["column"])),
        "total_missing": sum(facts.missing.values()),
        "missing_pct": sum(facts.missing.values()) / cells * 100,
        "duplicate_rows": duplicate_rows(seen).first()["duplicate_rows"],
        "dtypes": dict(df.dtypes),
        "describe": described,
        "correlation_matrix": matrix,
        "profile_sample_rows": seen_facts.rows,
    }
    if task == "classification":
        classes = class_distribution(df, target)
        result["n_classes"] = classes.count()
        # More classes than these are not listed; ``class_distribution`` gives them all.
        result["class_distribution_cut"] = result["n_classes"] > CLASS_LEVELS_SHOWN
        result["class_distribution"] = {str(r["class"]): r["share"] for r in classes.take(CLASS_LEVELS_SHOWN)}
    return result


def profile_json(df: DataFrame, target: str | None = None, **kwargs) -> str:
    return json.dumps(profile(df, target, **kwargs), default=str)
