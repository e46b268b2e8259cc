"""Splits, folds, metrics, ranking and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, table
from tabwright.operators import board, metrics, split
from tabwright.sources.store import Store, latest, merged_changes
from tabwright.session import scratch_path

# Splits


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")


_HASH = "md5('42-' || o_orderkey)"


@query(
    "split_holdout",
    f"SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {_HASH}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM orders",
)
def split_holdout(spark, sf_dir):
    return split.holdout_split(_orders(spark, sf_dir), ["o_orderkey"])


@query(
    "split_stratified",
    "WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), "
    "t AS (SELECT ceil(0.2 * sum(n)) AS want, sum(n) AS total FROM c), "
    "q AS (SELECT s, n, CASE WHEN n > 1 THEN n * want / total ELSE 0 END AS e FROM c, t), "
    "r AS (SELECT s, n, floor(e) AS f, row_number() OVER (ORDER BY n > 1 DESC, round(e - floor(e), 9) DESC, s) AS place FROM q), "
    "k AS (SELECT s, f + CASE WHEN n > 1 AND place <= (SELECT want FROM t) - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END AS quota FROM r) "
    f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH}) <= quota AS is_test "
    "FROM orders JOIN k ON s = o_orderstatus",
)
def split_stratified(spark, sf_dir):
    return split.stratified_split(_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"])


_FOLD_SIZES = "(SELECT count(*) AS n FROM orders)"


@query(
    "kfold",
    f"WITH z AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {_HASH}) - 1 AS p FROM orders), n AS {_FOLD_SIZES} "
    "SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) "
    "ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM z, n",
)
def kfold(spark, sf_dir):
    return split.kfold(_orders(spark, sf_dir), ["o_orderkey"])


@query(
    "kfold_stratified",
    "WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), "
    "e AS (SELECT s, sum(n) OVER (ORDER BY s) AS stop, sum(n) OVER (ORDER BY s) - n AS start FROM c), "
    "d AS (SELECT s, i, count(*) FILTER ((start + j) % 5 = i) AS held FROM (SELECT s, start, unnest(range(CAST(stop - start AS BIGINT))) AS j FROM e), "
    "range(5) AS f(i) GROUP BY s, i), "
    "b AS (SELECT s, i, sum(held) OVER (PARTITION BY s ORDER BY i) AS upto, sum(held) OVER (PARTITION BY s ORDER BY i) - held AS after FROM d), "
    f"z AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HASH}) AS p FROM orders) "
    "SELECT o_orderkey, o_orderstatus, CAST(i AS INTEGER) AS fold FROM z JOIN b ON s = o_orderstatus AND p > after AND p <= upto",
)
def kfold_stratified(spark, sf_dir):
    return split.stratified_kfold(_orders(spark, sf_dir), "o_orderstatus", ["o_orderkey"])


# Metrics of rule-based predictors: each rule is SQL that both engines read.

_RULES = {
    "by_quantity": "CASE WHEN l_quantity > 34 THEN 'A' WHEN l_quantity > 17 THEN 'N' ELSE 'R' END",
    "by_line": "CASE WHEN l_linenumber >= 5 THEN 'A' ELSE 'N' END",
    "by_discount": "CASE WHEN l_discount < 0.03 THEN 'R' WHEN l_discount < 0.06 THEN 'N' ELSE 'A' END",
    "always_a": "'A'",
}
_TIMES = {"by_quantity": 1.25, "by_line": 0.75, "by_discount": 2.0, "always_a": 0.25}


def _predicted(spark, sf_dir):
    rules = F.array(
        *[F.struct(F.lit(name).alias("model"), F.expr(rule).alias("prediction")) for name, rule in _RULES.items()]
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.explode(rules).alias("p"))
    return rows.select("label", "p.model", "p.prediction")


_PREDICTED = "(" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, l_returnflag AS label, {rule} AS prediction FROM lineitem" for name, rule in _RULES.items()
) + ")"
_CLASS_SQL = (
    f"WITH p AS {_PREDICTED}, k AS (SELECT DISTINCT model, label AS c FROM p UNION SELECT DISTINCT model, prediction FROM p), "
    "s AS (SELECT k.model, c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS called, "
    "count(*) FILTER (label = c AND prediction = c) AS hits FROM k JOIN p ON p.model = k.model GROUP BY 1, 2), "
    "m AS (SELECT *, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re, "
    "2 * hits / (support + called) AS f1 FROM s), "
    "r AS (SELECT model, sum(hits) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision_weighted, "
    "sum(re * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted FROM m GROUP BY model) "
)
_CLASS_COLUMNS = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")
_CLASS_ROUNDED = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _CLASS_COLUMNS)


@query("metrics_class", f"{_CLASS_SQL} SELECT model, {_CLASS_ROUNDED} FROM r")
def metrics_class(spark, sf_dir):
    scored = metrics.classification_metrics(_predicted(spark, sf_dir), by=["model"])
    return scored.select("model", *[F.round(c, 6).alias(c) for c in _CLASS_COLUMNS])


def _auc_sql(source: str) -> str:
    """Area per class by average ranks over ``(class, hit, score)``."""
    return (
        f"WITH l AS ({source}), r AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY score) + "
        "(count(*) OVER (PARTITION BY class, score) - 1) / 2 AS k FROM l), "
        "a AS (SELECT class, (sum(k) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2) / "
        "(count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc, count(*) FILTER (hit) AS n FROM r GROUP BY class)"
    )


@query(
    "metrics_auc",
    _auc_sql("SELECT 0 AS class, l_linestatus = 'O' AS hit, l_discount * 10 + l_quantity AS score FROM lineitem")
    + " SELECT round(CAST(auc AS DOUBLE), 6) AS roc_auc FROM a",
)
def metrics_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linestatus") == "O").alias("hit"), (F.col("l_discount") * 10 + F.col("l_quantity")).alias("score")
    )
    return metrics.roc_auc(rows, "hit", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


_SCORES = ("l_quantity", "l_discount * 100", "l_tax * 50")


@query(
    "metrics_auc_ovr",
    _auc_sql(
        " UNION ALL ".join(
            f"SELECT {i} AS class, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END = {i} AS hit, {s} AS score FROM lineitem"
            for i, s in enumerate(_SCORES)
        )
    )
    + " SELECT round(CAST(sum(auc * n) / sum(n) AS DOUBLE), 6) AS roc_auc FROM a",
)
def metrics_auc_ovr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("label"),
        F.array(*[F.expr(s) for s in _SCORES]).alias("scores"),
    )
    return metrics.roc_auc_one_vs_rest(rows, "label", "scores").select(F.round("roc_auc", 6).alias("roc_auc"))


_GUESS = "l_quantity * 1400 + l_partkey"


@query(
    "metrics_regression",
    f"WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - ({_GUESS}) AS e FROM lineitem) "
    "SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e * e), 2) AS mse, round(avg(abs(e)), 4) AS mae, "
    "round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e",
)
def metrics_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("label"), F.expr(_GUESS).alias("prediction")
    )
    scored = metrics.regression_metrics(rows)
    return scored.select(
        F.round("rmse", 4).alias("rmse"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2")
    )


# Ranking


def _board(spark, sf_dir):
    times = F.create_map(*[part for name, t in _TIMES.items() for part in (F.lit(name), F.lit(t))])
    scored = metrics_class(spark, sf_dir)
    return scored.select("model", times[F.col("model")].alias("training_time"), *_CLASS_COLUMNS)


_TIME_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in _TIMES.items()) + " END"
_BOARD_SQL = f"{_CLASS_SQL}, b AS (SELECT model, CAST({_TIME_SQL} AS DOUBLE) AS training_time, {_CLASS_ROUNDED} FROM r) "


@query(
    "leaderboard",
    _BOARD_SQL
    + "SELECT CAST(row_number() OVER (ORDER BY f1_weighted DESC, training_time, model) AS INTEGER) AS place, * FROM b",
)
def leaderboard(spark, sf_dir):
    """Rank the rules, save the board and read it back in order."""
    store = Store(spark, scratch_path(spark, "store"))
    store.save_board("rules", _board(spark, sf_dir), "f1")
    saved = store.board("rules").coalesce(1)
    return saved.select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), "*")


@query(
    "best_model",
    _BOARD_SQL
    + "SELECT model, 'accuracy' AS metric_name, accuracy AS metric_value, training_time FROM b ORDER BY accuracy DESC, training_time, model LIMIT 1",
)
def best_model(spark, sf_dir):
    return board.best_model(_board(spark, sf_dir), "accuracy")


# Run log


_CHANGED = ("click", "error", "purchase", "signup", "view")


@query(
    "run_states",
    "WITH c AS (SELECT user_id, event_type AS field, value, event_id FROM events), "
    "l AS (SELECT user_id, field, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY event_id DESC) = 1) "
    "SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in _CHANGED) + " FROM l GROUP BY user_id",
)
def run_states(spark, sf_dir):
    """Single changes merged per field, with the users as runs and the kinds of event as fields."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), "event_id")
    return merged_changes(events, ["user_id"], dict.fromkeys(_CHANGED, "double"), ["event_id"])


@query(
    "run_latest",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def run_latest(spark, sf_dir):
    """Latest state per key of an append-only log, with the users as runs."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return latest(log, ["user_id"], "event_id")
