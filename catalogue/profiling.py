"""Profile, meta-features and advice."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalogue.registry import (
    LINEITEM_COLUMNS,
    LINEITEM_NUMBERS,
    LINEITEM_SQL,
    lineitem,
    query,
    table,
)
from tabwright.models.catalog import list_models
from tabwright.operators import meta, profile
from tabwright.sources.load import preview

_MISSING_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c})) / greatest(count(*), 1) * 100, 4) AS missing_pct FROM g"
    for c in LINEITEM_COLUMNS
)
_MISSING = f"WITH g AS {LINEITEM_SQL} SELECT * FROM ({_MISSING_ROWS}) WHERE missing_count > 0"


@query("profile_missing", _MISSING)
def profile_missing(spark, sf_dir):
    return profile.missing_by_column(lineitem(spark, sf_dir))


@query(
    "profile_missing_totals",
    f"WITH g AS {LINEITEM_SQL} SELECT CAST("
    + " + ".join(f"count(*) - count({c})" for c in LINEITEM_COLUMNS)
    + " AS BIGINT) AS total_missing, round(("
    + " + ".join(f"count(*) - count({c})" for c in LINEITEM_COLUMNS)
    + f") / (count(*) * {len(LINEITEM_COLUMNS)}) * 100, 6) AS missing_pct FROM g",
)
def profile_missing_totals(spark, sf_dir):
    totals = profile.missing_totals(lineitem(spark, sf_dir))
    return totals.select("total_missing", F.round("missing_pct", 6).alias("missing_pct"))


@query(
    "profile_overview",
    f"SELECT count(*) AS n_rows, CAST({len(LINEITEM_COLUMNS)} AS BIGINT) AS n_cols, "
    f"CAST({len(LINEITEM_COLUMNS) - 1} AS BIGINT) AS n_features, "
    f"CAST({len(LINEITEM_NUMBERS)} AS BIGINT) AS n_numerical, CAST(1 AS BIGINT) AS n_categorical FROM lineitem",
)
def profile_overview(spark, sf_dir):
    return profile.overview(lineitem(spark, sf_dir), "l_returnflag")


def _describe(column: str) -> str:
    stats = {
        "count": f"count({column})",
        "mean": f"avg({column})",
        "std": f"stddev_samp({column})",
        "min": f"min({column})",
        "25%": f"quantile_cont({column}, 0.25)",
        "50%": f"quantile_cont({column}, 0.5)",
        "75%": f"quantile_cont({column}, 0.75)",
        "max": f"max({column})",
    }
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{stat}' AS stat, "
        f"round(coalesce(CAST({value} AS DOUBLE), 0), 4) AS value FROM g"
        for stat, value in stats.items()
    )


@query(
    "profile_describe_num",
    f"WITH g AS {LINEITEM_SQL} " + " UNION ALL ".join(_describe(c) for c in LINEITEM_NUMBERS),
)
def profile_describe_num(spark, sf_dir):
    return profile.describe_numeric(lineitem(spark, sf_dir))


_ORDER_TEXTS = ("o_orderstatus", "o_orderdate", "o_orderpriority")


@query(
    "profile_describe_text",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS count, count(*) AS \"unique\", "
        f"arg_max(v, (n, r)) AS top, max(n) AS freq FROM ("
        f"SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, "
        f"row_number() OVER (ORDER BY CAST({c} AS VARCHAR) DESC) AS r FROM orders GROUP BY 1)"
        for c in _ORDER_TEXTS
    ),
)
def profile_describe_text(spark, sf_dir):
    return profile.describe_text(table(spark, sf_dir, "orders"))


def _corr(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0)"


@query(
    "profile_corr",
    f"WITH g AS {LINEITEM_SQL}, p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr(a, b)}, 4) AS corr FROM g"
        for a, b in combinations(LINEITEM_NUMBERS, 2)
    )
    + ") SELECT * FROM p UNION ALL SELECT col_b AS col_a, col_a AS col_b, corr FROM p UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', '{c}', CAST(CASE WHEN min({c}) < max({c}) THEN 1 ELSE 0 END AS DOUBLE) FROM g"
        for c in LINEITEM_NUMBERS
    ),
)
def profile_corr(spark, sf_dir):
    return profile.correlation(lineitem(spark, sf_dir))


@query(
    "profile_duplicates",
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows "
    "FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
)
def profile_duplicates(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


@query(
    "profile_classes",
    "SELECT l_returnflag AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share "
    "FROM lineitem GROUP BY l_returnflag",
)
def profile_classes(spark, sf_dir):
    classes = profile.class_distribution(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return classes.withColumn("share", F.round("share", 6))


_TARGETS = (("lineitem", "l_returnflag"), ("events", "value"), ("part", "p_size"), ("customer", "c_nationkey"))


@query(
    "profile_problem_type",
    " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS target, count(*) AS n_rows, count(DISTINCT {c}) AS n_values, "
        + (
            "'classification'"
            if c == "l_returnflag"
            else f"CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) / count(*) < 0.05 "
            "THEN 'classification' ELSE 'regression' END"
        )
        + f" AS problem_type FROM {t}"
        for t, c in _TARGETS
    ),
)
def profile_problem_type(spark, sf_dir):
    frames = [
        profile.problem_type_frame(table(spark, sf_dir, t), c).select(F.lit(f"{t}.{c}").alias("target"), "*")
        for t, c in _TARGETS
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionAll(frame)
    return result


@query(
    "profile_sample",
    f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42-' || o_orderkey) LIMIT {profile.SAMPLE_ROWS}",
)
def profile_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.bounded_sample(orders, profile.SAMPLE_ROWS, ["o_orderkey"])


@query(
    "preview",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '') AS o_orderstatus, "
    "CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority "
    "FROM orders ORDER BY orders.o_orderkey LIMIT 15",
)
def preview_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END")
    )
    return preview(orders, order=["o_orderkey"])


_ADVICE = profile.ADVICE
_ADVICE_FACTS = (
    f"WITH g AS {LINEITEM_SQL}, m AS (SELECT "
    + " + ".join(f"count(*) - count({c})" for c in LINEITEM_COLUMNS)
    + " AS missing, count(*) AS n FROM g), "
    "c AS (SELECT min(s) AS low, max(s) AS high FROM "
    "(SELECT count(*) / (SELECT n FROM m) * 100 AS s FROM g GROUP BY l_returnflag))"
)


def _advice_select(kind: str, description: str, condition: str, seq: int) -> str:
    title, _, recommendation = _ADVICE[kind]
    return (
        f"SELECT {seq} AS rank, '{title}' AS title, {description} AS description, "
        f"'{recommendation}' AS recommendation FROM m, c WHERE {condition}"
    )


_ADVICE_SQL = (
    _ADVICE_FACTS
    + " SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS seq, title, description, recommendation FROM ("
    + " UNION ALL ".join(
        [
            _advice_select("missing", "format('Found {} missing values across columns.', missing)", "missing > 0", 1),
            _advice_select("complete", f"'{_ADVICE['complete'][1]}'", "missing = 0", 1),
            _advice_select(
                "imbalance", "format('Target class ranges from {:.1f}% to {:.1f}%.', low, high)", "high - low > 50", 2
            ),
            _advice_select(
                "balanced",
                "format('Classes are evenly distributed ({:.1f}% – {:.1f}%).', low, high)",
                "high - low <= 50",
                2,
            ),
            _advice_select("small", "format('Dataset has only {} rows.', n)", "n < 100", 3),
            _advice_select("large", "format('Dataset has {:,} rows.', n)", "n > 100000", 3),
        ]
    )
    + ")"
)


@query("advice", _ADVICE_SQL)
def advice(spark, sf_dir):
    return profile.advice(lineitem(spark, sf_dir), "l_returnflag")


@query(
    "chart_missing",
    f"SELECT \"column\", missing_count AS missing FROM ({_MISSING}) ORDER BY missing_pct DESC, \"column\" LIMIT 12",
)
def chart_missing(spark, sf_dir):
    return profile.chart_missing(lineitem(spark, sf_dir))


@query(
    "chart_classes",
    "SELECT o_orderpriority AS label, round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS pct "
    "FROM orders GROUP BY o_orderpriority",
)
def chart_classes(spark, sf_dir):
    chart = profile.chart_classes(table(spark, sf_dir, "orders"), "o_orderpriority")
    return chart.withColumn("pct", F.round("pct", 6))


def _meta_sql(source: str, columns: list[str], numbers: list[str], target: str) -> str:
    """Meta-features of a table as one SQL row, unrounded."""
    features = [c for c in columns if c != target]
    nulls = " + ".join(f"count(*) - count({c})" for c in features)
    pairs = " + ".join(f"abs({_corr(a, b)})" for a, b in combinations(numbers, 2))
    complete = " AND ".join(f"{c} IS NOT NULL" for c in numbers)
    quartiles = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in numbers
    )
    outside = " OR ".join(
        f"({c}_3 > {c}_1 AND ({c} < {c}_1 - 1.5 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5 * ({c}_3 - {c}_1)))"
        for c in numbers
    )
    return (
        f"WITH g AS {source}, k AS (SELECT count(*) AS n FROM g GROUP BY {target}), "
        f"s AS (SELECT * FROM g WHERE {complete}), q AS (SELECT {quartiles} FROM s), "
        f"o AS (SELECT avg(CASE WHEN {outside} THEN 1.0 ELSE 0.0 END) AS ratio FROM s, q), "
        f"m AS (SELECT count(*) AS n_samples, CAST({len(features)} AS BIGINT) AS n_features, "
        f"CAST({len(numbers)} AS BIGINT) AS n_numerical, CAST({len(features) - len(numbers)} AS BIGINT) AS n_categorical, "
        f"({nulls}) / greatest(count(*) * {len(features)}, 1) AS missing_ratio, "
        f"CASE WHEN count(DISTINCT {target}) > 1 THEN (SELECT max(n) / min(n) FROM k) ELSE 1.0 END AS class_imbalance_ratio, "
        f"2 * ({pairs}) / {len(numbers) ** 2} AS mean_correlation, "
        f"(SELECT ratio FROM o) AS outlier_ratio FROM g) "
        "SELECT *, least(greatest((1 - least(n_samples / 10000, 1)) * 0.2 "
        "+ least(n_features / greatest(n_samples, 1) * 10, 1) * 0.2 + least(missing_ratio * 4, 1) * 0.2 "
        "+ least((class_imbalance_ratio - 1) / 10, 1) * 0.2 + least(outlier_ratio * 3, 1) * 0.2, 0), 1) "
        "AS difficulty_score FROM m"
    )


_META = _meta_sql(
    LINEITEM_SQL, list(LINEITEM_COLUMNS), LINEITEM_NUMBERS, "l_returnflag"
)
_RATIOS = ("missing_ratio", "class_imbalance_ratio", "mean_correlation", "outlier_ratio", "difficulty_score")
_DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars"]
_DOC_META = _meta_sql("(SELECT doc_id, lang, source, n_chars FROM documents)", _DOC_COLUMNS, ["doc_id", "n_chars"], "source")


def _rounded(sql: str) -> str:
    return (
        "SELECT n_samples, n_features, n_numerical, n_categorical, "
        + ", ".join(f"round(CAST({r} AS DOUBLE), 5) AS {r}" for r in _RATIOS)
        + f" FROM ({sql})"
    )


@query("meta_features", _rounded(_META))
def meta_features(spark, sf_dir):
    row = meta.meta_features(lineitem(spark, sf_dir), "l_returnflag")
    return row.select(*row.columns[:4], *[F.round(r, 5).alias(r) for r in _RATIOS])


@query("meta_features_documents", _rounded(_DOC_META))
def meta_features_documents(spark, sf_dir):
    row = meta.meta_features(table(spark, sf_dir, "documents").select(*_DOC_COLUMNS), "source")
    return row.select(*row.columns[:4], *[F.round(r, 5).alias(r) for r in _RATIOS])


def _recommend_sql(sql: str, task: str, top_k: int = 5) -> str:
    known = list_models(task)
    rows = []
    for kind, names in meta.FIRST_CHOICES[task].items():
        ordered = names + [m for m in known if m not in names]
        rows += [f"('{kind}', {i}, '{m}')" for i, m in enumerate(ordered[:top_k], start=1)]
    return (
        f"SELECT CAST(seq AS INTEGER) AS seq, model FROM (VALUES {', '.join(rows)}) AS v(kind, seq, model), ({sql}) "
        "WHERE kind = CASE WHEN difficulty_score >= 0.6 THEN 'hard' WHEN n_samples < 1000 THEN 'small' ELSE 'other' END"
    )


@query("recommend", _recommend_sql(_META, "classification"))
def recommend(spark, sf_dir):
    return meta.recommend_frame(meta.meta_features(lineitem(spark, sf_dir), "l_returnflag"), "classification")


@query("recommend_regression", _recommend_sql(_DOC_META, "regression"))
def recommend_regression(spark, sf_dir):
    facts = meta.meta_features(table(spark, sf_dir, "documents").select(*_DOC_COLUMNS), "source")
    return meta.recommend_frame(facts, "regression")
