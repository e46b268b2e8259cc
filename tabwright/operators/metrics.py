"""Scores of predictions against labels, from counts that aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double
from tabwright.functions.ordering import running_totals

CLASS_METRICS = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "roc_auc")
VALUE_METRICS = ("rmse", "mse", "mae", "r2")

# Other names of the metrics, and the ones where less is better.
ALIASES = {
    "f1": "f1_weighted",
    "f1 score": "f1_weighted",
    "precision": "precision_weighted",
    "recall": "recall_weighted",
}
LOWER_IS_BETTER = ("rmse", "mae", "mse")


def metric_key(metric: str) -> str:
    return ALIASES.get(metric.lower(), metric.lower())


def lower_is_better(metric: str) -> bool:
    return metric_key(metric) in LOWER_IS_BETTER


def check_metric(metric: str | None, task: str) -> str:
    """Resolved metric name; accuracy or rmse if none is given, an error if it does not fit the task."""
    known = CLASS_METRICS if task == "classification" else VALUE_METRICS
    if metric is None:
        return known[0]
    key = metric_key(metric)
    if key not in known:
        raise ValueError(f"metric {metric!r} does not suit {task}; use one of {', '.join(known)}")
    return key


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and precision, recall and F1 weighted by class size; 0 on an empty denominator.

    ``by`` scores several sets of predictions at once, one row per group.
    """
    by = list(by)
    cells = confusion(df, label, prediction, by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")

    def side(kind: str, support, hits, called):
        return F.struct(F.col(kind).alias("class"), support.alias("support"), hits.alias("hits"), called.alias("called"))

    # Each cell counts once for its label and once for its prediction.
    pair = F.array(side("label", F.col("n"), hit, none), side("prediction", none, none, F.col("n")))
    sides = cells.select(*by, F.inline(pair))
    classes = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("hits").alias("hits"), F.sum("called").alias("called")
    )
    precision = F.coalesce(F.try_divide("hits", "called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("called")), F.lit(0.0))
    weighted = lambda value: F.sum(value * F.col("support")) / F.sum("support")
    return classes.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision_weighted"),
        weighted(recall).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
    )


def roc_auc(df: DataFrame, positive: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in the right order.

    Rows are first counted per distinct score, then each score needs only the number of negatives
    below it. Tied pairs count one half. The area is null without both kinds.
    """
    by = list(by)
    is_positive = F.col(positive).cast("int")
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(is_positive).alias("pos"), F.sum(1 - is_positive).alias("neg")
    )
    placed = running_totals(counts.where(F.col("score").isNotNull()), "score", ["neg"], by)
    sums = placed.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * (F.col("before_neg") + 0.5 * F.col("neg"))).alias("_ordered"),
        F.sum("pos").cast("double").alias("_pos"),
        F.sum("neg").cast("double").alias("_neg"),
    )
    return sums.select(*by, F.try_divide(F.col("_ordered"), F.col("_pos") * F.col("_neg")).alias("roc_auc"))


def roc_auc_one_vs_rest(df: DataFrame, label: str, scores: str) -> DataFrame:
    """Area of each class against the rest, weighted by class size; ``scores`` is an array by class code.

    Null if any class has no rows, as the area of that class is not defined.
    """
    long = df.select(F.col(label).alias("_label"), F.posexplode(scores).alias("class", "score")).withColumn(
        "hit", F.col("_label") == F.col("class")
    )
    areas = roc_auc(long, "hit", "score", ["class"])
    support = long.where("hit").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    joined = areas.join(support, "class", "left")
    whole = F.count_if(F.col("roc_auc").isNull()) == 0
    return joined.agg(F.when(whole, F.sum(F.col("roc_auc") * F.col("n")) / F.sum("n")).alias("roc_auc"))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    y, e = as_double(label), as_double(label) - as_double(prediction)
    fitted = df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_spread")
    )
    # A target without spread is explained fully by an exact prediction and not at all otherwise.
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return fitted.select(
        *by,
        F.sqrt("mse").alias("rmse"),
        "mse",
        "mae",
        F.when(F.col("_spread") > 0, 1 - F.try_divide("mse", "_spread")).otherwise(flat).alias("r2"),
    )


def evaluate(scored: DataFrame, task: str, classes: int = 2, only: str | None = None) -> dict[str, float | None]:
    """All metrics of one scored frame with ``label``, ``prediction`` and, if it has it, ``scores``.

    ``only`` names a single metric that is needed, to save the jobs of the others.
    """
    if task == "regression":
        return regression_metrics(scored).first().asDict()
    found = {} if only == "roc_auc" else classification_metrics(scored).first().asDict()
    found["roc_auc"] = None
    if "scores" in scored.columns and only in (None, "roc_auc"):
        if classes == 2:
            pairs = scored.select((F.col("label") == 1).alias("hit"), F.get("scores", F.lit(1)).alias("score"))
            found["roc_auc"] = roc_auc(pairs, "hit", "score").first()["roc_auc"]
        else:
            found["roc_auc"] = roc_auc_one_vs_rest(scored, "label", "scores").first()["roc_auc"]
    return found
