"""Scoring of streams, admission, registry, feature choice by rule, scores by name and what a dashboard shows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.registry import LINEITEM_GAPS, LINEITEM_SQL, lineitem, query, table
from tabwright.models.build import TrainFacts, build_model
from tabwright.operators import board, metrics, profile, select
from tabwright.operators.prep import fit_preprocessing
from tabwright.session import scratch_path
from tabwright.sources import load
from tabwright.sources.store import Store
from tabwright.streaming.score import score_new_files

# Scoring a stream

_LINE = "(SELECT regr_slope(p_retailprice, p_partkey) AS b, regr_intercept(p_retailprice, p_partkey) AS a FROM part)"


@query("stream_scores", f"SELECT p_partkey, round(a + b * p_partkey, 4) AS price FROM part, {_LINE}")
def stream_scores(spark, sf_dir):
    """A saved regression scores the parts as files that arrive in two lots, with a restart between."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("label"))
    assemble = VectorAssembler(inputCols=["x"], outputCol="features")
    train = assemble.transform(parts)
    fitted = build_model("LinearRegression", "regression", {}, TrainFacts.of(train, "regression")).fit(train)
    saved, folder = scratch_path(spark, "model"), scratch_path(spark, "stream")
    PipelineModel([assemble, fitted]).write().save(saved)
    pipeline = PipelineModel.load(saved)
    late = F.pmod(F.xxhash64("p_partkey"), F.lit(2)) == 1
    scored = None
    for lot in (~late, late):
        parts.where(lot).write.mode("append").parquet(f"{folder}/in")
        scored = score_new_files(spark, f"{folder}/in", parts.schema, pipeline, f"{folder}/out", f"{folder}/state", ["p_partkey", "prediction"])
    return scored.select("p_partkey", F.round("prediction", 4).alias("price"))


# Admission and registry

_LIMITS = (1, 10, 1_000, 1_000_000_000)


def _admitted(df, **limits) -> str:
    try:
        load.check_rows(df, **limits)
        return "yes"
    except ValueError as refusal:
        return "empty" if "empty" in str(refusal) else "too few rows"


@query(
    "admission",
    "WITH n AS (SELECT count(*) AS n FROM orders), l AS (SELECT unnest(["
    + ", ".join(map(str, _LIMITS))
    + "]) AS needed) SELECT CAST(needed AS BIGINT) AS needed, CASE WHEN n >= needed THEN 'yes' ELSE 'too few rows' END AS admitted FROM l, n "
    "UNION ALL SELECT 0, 'empty'",
)
def admission(spark, sf_dir):
    """Whether the orders are enough for several limits, and an empty selection of them."""
    orders = table(spark, sf_dir, "orders")
    rows = [(n, _admitted(orders, min_rows=n)) for n in _LIMITS]
    return spark.createDataFrame([*rows, (0, _admitted(orders.where("o_orderkey IS NULL")))], "needed bigint, admitted string")


@query("shape", "SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns, 'l_linestatus' AS target FROM " + LINEITEM_SQL)
def shape(spark, sf_dir):
    found = load.shape(lineitem(spark, sf_dir))
    return spark.createDataFrame([(found["rows"], len(found["columns"]), found["target"])], "n_rows bigint, n_columns bigint, target string")


@query(
    "dataset_registry",
    "SELECT 'orders' AS name, count(*) AS n_rows, 6 AS n_cols, 'o_orderstatus' AS target FROM orders UNION ALL SELECT 'customer', count(*), 5, 'c_mktsegment' FROM customer",
)
def dataset_registry(spark, sf_dir):
    """Data sets with their profiles, registered and read back."""
    store = Store(spark, scratch_path(spark, "store"))
    for name, target in (("orders", "o_orderstatus"), ("customer", "c_mktsegment")):
        rows = table(spark, sf_dir, name)
        facts = load.shape(rows)
        store.register_dataset(name, {"n_rows": facts["rows"], "n_cols": len(rows.columns), "target": target})
    kept = store.datasets().select("path", F.from_json("profile", "n_rows bigint, n_cols int, target string").alias("p"))
    return kept.select(F.col("path").alias("name"), "p.n_rows", "p.n_cols", "p.target")


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float", "BOOLEAN": "boolean"}


@query(
    "profile_dtypes",
    "SELECT column_name AS \"column\", CASE "
    + " ".join(f"WHEN column_type = '{d}' THEN '{s}'" for d, s in _KINDS.items())
    + " WHEN column_type LIKE 'DECIMAL%' THEN lower(column_type) WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp' END AS dtype FROM (DESCRIBE SELECT "
    + LINEITEM_GAPS
    + " FROM lineitem)",
)
def profile_dtypes(spark, sf_dir):
    return profile.dtypes_frame(lineitem(spark, sf_dir))


@query(
    "profile_whole",
    f"WITH g AS MATERIALIZED {LINEITEM_SQL}, c AS (SELECT l_returnflag, count(*) AS n FROM g GROUP BY 1) SELECT (SELECT count(*) FROM g) AS n_rows, "
    "(SELECT count(*) FROM c) AS n_classes, (SELECT CAST(count(*) * 3 - count(l_discount) - count(l_tax) - count(l_linestatus) AS BIGINT) FROM g) AS total_missing, "
    "(SELECT round(avg(l_quantity), 2) FROM g) AS mean_quantity, (SELECT round(corr(l_quantity, l_extendedprice), 4) FROM g) AS corr_price, "
    "'classification' AS problem_type, (SELECT round(max(n) / sum(n), 6) FROM c) AS top_share",
)
def profile_whole(spark, sf_dir):
    """Parts of the whole profile in one call."""
    p = profile.profile(lineitem(spark, sf_dir), "l_returnflag")
    shares = max(p["class_distribution"].values())
    row = (p["n_rows"], p["n_classes"], p["total_missing"], round(p["describe"]["l_quantity"]["mean"], 2), p["correlation_matrix"]["l_quantity"]["l_extendedprice"], p["problem_type"], round(shares, 6))
    return spark.createDataFrame([row], "n_rows bigint, n_classes bigint, total_missing bigint, mean_quantity double, corr_price double, problem_type string, top_share double")


# Choice of features


@query(
    "select_first",
    "WITH c AS (SELECT column_name AS feature, row_number() OVER () AS place FROM (DESCRIBE part) WHERE column_name <> 'p_retailprice'), "
    "n AS (SELECT count(*) AS n FROM c), w AS (SELECT unnest([0, 3, 99]) AS wanted) "
    "SELECT CAST(wanted AS INTEGER) AS wanted, feature FROM w, c, n WHERE place <= greatest(1, least(wanted, n))",
)
def select_first(spark, sf_dir):
    """The first features of the table, with the number clamped to what there is."""
    parts = table(spark, sf_dir, "part")
    parts = parts.select(*[c for c in parts.columns if c != "p_retailprice"], "p_retailprice")
    rows = [(k, c) for k in (0, 3, 99) for c in select.select_features(parts, "p_retailprice", "first", k)]
    return spark.createDataFrame(rows, "wanted int, feature string")


@query(
    "scale_none",
    f"WITH g AS {LINEITEM_SQL} SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_discount, (SELECT median(l_discount) FROM g)) AS discount, CAST(l_quantity AS DOUBLE) AS quantity FROM g",
)
def scale_none(spark, sf_dir):
    """Preprocessing that fills gaps and leaves the scale as it is."""
    rows = lineitem(spark, sf_dir)
    stages = fit_preprocessing(rows, ["l_discount", "l_quantity"], [], "median", "none")
    v = vector_to_array(F.col("features"))
    return stages.transform(rows).select("l_orderkey", "l_linenumber", "l_partkey", v[0].alias("discount"), v[1].alias("quantity"))


# Scores by name, and what is shown

_NAMES = ("accuracy", "f1", "Precision", "recall", "f1 score")


def _ruled(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("CAST(o_orderstatus = 'F' AS DOUBLE) AS label", "CAST(o_totalprice > 150000 AS DOUBLE) AS prediction")


@query(
    "scores_by_name",
    "WITH p AS (SELECT o_orderstatus = 'F' AS y, o_totalprice > 150000 AS q FROM orders), "
    "c AS (SELECT k, count(*) FILTER (y = k) AS s, count(*) FILTER (y = k AND q = k) AS h, count(*) FILTER (q = k) AS d FROM p, (SELECT unnest([true, false]) AS k) GROUP BY k), "
    "m AS (SELECT sum(h) / sum(s) AS acc, sum(coalesce(h / nullif(d, 0), 0) * s) / sum(s) AS pre, sum(coalesce(h / nullif(s, 0), 0) * s) / sum(s) AS rec, "
    "sum(coalesce(2 * h / nullif(s + d, 0), 0) * s) / sum(s) AS f FROM c) "
    "SELECT name, round(CASE name WHEN 'accuracy' THEN acc WHEN 'Precision' THEN pre WHEN 'recall' THEN rec ELSE f END, 9) AS score, false AS lower_is_better "
    f"FROM m, (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS name)",
)
def scores_by_name(spark, sf_dir):
    """Metrics by the names a user may give, each worked out on its own, with their direction."""
    rows = _ruled(spark, sf_dir)
    out = []
    for name in _NAMES:
        key = metrics.check_metric(name, "classification")
        out.append((name, round(metrics.evaluate(rows, "classification", only=key)[key], 9), metrics.lower_is_better(name)))
    return spark.createDataFrame(out, "name string, score double, lower_is_better boolean")


_RULES = 12


@query(
    "leaderboard_shown",
    f"WITH r AS (SELECT i, i * 30000 AS cut FROM range(1, {_RULES + 1}) t(i)), m AS (SELECT 'rule ' || lpad(CAST(i AS VARCHAR), 2, '0') AS model, "
    "round(avg(((o_orderstatus = 'F') = (o_totalprice > cut))::INT), 9) AS accuracy FROM orders, r GROUP BY 1) "
    "SELECT model, accuracy FROM m ORDER BY accuracy DESC, model LIMIT 10",
)
def leaderboard_shown(spark, sf_dir):
    """The ten best of twelve rules, as a dashboard shows them."""
    orders = table(spark, sf_dir, "orders")
    hits = [
        F.round(F.avg(((F.col("o_orderstatus") == "F") == (F.col("o_totalprice") > i * 30000)).cast("int")), 9).alias(f"rule {i:02d}")
        for i in range(1, _RULES + 1)
    ]
    found = orders.agg(*hits).first().asDict()
    rows = board.board_rows(spark, [{"model": m, "training_time": 0.0, "metrics": {"accuracy": v}} for m, v in found.items()], "classification")
    return board.display(rows, "accuracy").select("model", "accuracy")
