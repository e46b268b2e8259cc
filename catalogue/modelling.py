"""Models, tuning, whole runs and explanations."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalogue.registry import query, table
from tabwright.functions.small import spread
from tabwright.models.boosting import BoostedTrees
from tabwright.models.build import TrainFacts, build_model, scored_columns
from tabwright.models.catalog import list_models
from tabwright.operators import explain, prep
from tabwright.operators.board import board_rows
from tabwright.operators.kernel_shap import kernel_shap
from tabwright.operators.metrics import evaluate
from tabwright.operators.neighbours import nearest_neighbours, vote
from tabwright.operators.profile import bounded_sample
from tabwright.operators.split import kfold, stratified_kfold
from tabwright.operators.tree_shap import tree_shap
from tabwright.plans.run import run
from tabwright.plans.train import prepare_rows, split_rows, train_all
from tabwright.plans.tune import cross_validate, fold_frames, tune

# Tables to learn from


def _part_vectors(spark, sf_dir, columns):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", *[F.col(c).cast("double").alias(f"x_{c}") for c in columns], F.col("p_retailprice").alias("label")
    )
    return VectorAssembler(inputCols=[f"x_{c}" for c in columns], outputCol="features").transform(rows)


def _graded_documents(spark, sf_dir):
    """Labelled documents with shape features of their whole text; ``quality`` is the target."""
    words = F.split(F.trim("text"), r"\s+")
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size(words).alias("n_words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id")


_DOC_NUMBERS = ["n_chars", "n_words", "distinct_share"]
_DOC_TEXTS = ["lang", "source"]


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


# Linear models against their closed forms


def _line(model, digits=6):
    return [(round(float(model.coefficients[0]), digits), round(float(model.intercept), digits))]


_LINE = "slope double, intercept double"


@query(
    "model_linear_regression",
    "SELECT round(regr_slope(p_retailprice, p_partkey), 6) AS slope, round(regr_intercept(p_retailprice, p_partkey), 6) AS intercept FROM part",
)
def model_linear_regression(spark, sf_dir):
    train = _part_vectors(spark, sf_dir, ["p_partkey"])
    fitted = build_model("LinearRegression", "regression", {}, TrainFacts.of(train, "regression")).fit(train)
    return spark.createDataFrame(_line(fitted), _LINE)


@query(
    "model_ridge",
    "WITH s AS (SELECT regr_sxy(p_retailprice, p_size) AS sxy, regr_sxx(p_retailprice, p_size) AS sxx, "
    "avg(p_size) AS mx, avg(p_retailprice) AS my FROM part) "
    "SELECT round(sxy / (sxx + 50), 5) AS slope, round(my - mx * sxy / (sxx + 50), 5) AS intercept FROM s",
)
def model_ridge(spark, sf_dir):
    train = _part_vectors(spark, sf_dir, ["p_size"])
    fitted = build_model("Ridge", "regression", {"alpha": 50.0}, TrainFacts.of(train, "regression")).fit(train)
    return spark.createDataFrame(_line(fitted, 5), _LINE)


@query(
    "model_lasso",
    "WITH s AS (SELECT covar_pop(p_retailprice, p_partkey) AS c, var_pop(p_partkey) AS v, "
    "avg(p_partkey) AS mx, avg(p_retailprice) AS my FROM part), "
    "w AS (SELECT sign(c) * greatest(abs(c) - 20, 0) / v AS slope, mx, my FROM s) "
    "SELECT round(slope, 3) AS slope, round(my - slope * mx, 0) AS intercept FROM w",
)
def model_lasso(spark, sf_dir):
    train = _part_vectors(spark, sf_dir, ["p_partkey"])
    fitted = build_model("Lasso", "regression", {"alpha": 20.0}, TrainFacts.of(train, "regression")).fit(train)
    return spark.createDataFrame(
        [(round(float(fitted.coefficients[0]), 3), round(float(fitted.intercept), 0))], _LINE
    )


_BAYES = ("l_quantity", "l_discount", "l_extendedprice")


@query(
    "model_gaussian_bayes",
    "SELECT CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS class, "
    "round(ln(n / sum(n) OVER ()), 6) AS log_prior, "
    + ", ".join(f"round(m_{c}, 4) AS mean_{c}, round(v_{c} + floor, 4) AS var_{c}" for c in _BAYES)
    + " FROM (SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _BAYES)
    + " FROM lineitem GROUP BY 1), (SELECT 1e-9 * greatest("
    + ", ".join(f"var_pop({c})" for c in _BAYES)
    + ") AS floor FROM lineitem)",
)
def model_gaussian_bayes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.expr("CASE l_returnflag WHEN 'A' THEN 0D WHEN 'N' THEN 1D ELSE 2D END").alias("label"), *_BAYES
    )
    train = VectorAssembler(inputCols=list(_BAYES), outputCol="features").transform(rows)
    fitted = build_model("GaussianNB", "classification", {}, TrainFacts.of(train, "classification")).fit(train)
    prior, mean, spread = fitted.pi.toArray(), fitted.theta.toArray(), fitted.sigma.toArray()
    out = [
        (k, round(float(prior[k]), 6))
        + tuple(round(float(a[k][j]), 4) for j in range(len(_BAYES)) for a in (mean, spread))
        for k in range(len(prior))
    ]
    names = ", ".join(f"mean_{c} double, var_{c} double" for c in _BAYES)
    return spark.createDataFrame(out, f"class int, log_prior double, {names}")


_NEIGHBOURS = 5


@query(
    "model_neighbours",
    "WITH d AS (SELECT a.vec_id, b.vec_id AS other, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), "
    "lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS k FROM d), "
    f"n AS (SELECT * FROM r WHERE k <= {_NEIGHBOURS}), v AS (SELECT vec_id, label, count(*) AS votes FROM n GROUP BY 1, 2), "
    "w AS (SELECT vec_id, label FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1) "
    "SELECT w.vec_id, CAST(w.label AS DOUBLE) AS prediction, n.other AS nearest, round(n.distance, 6) AS distance "
    "FROM w JOIN n ON n.vec_id = w.vec_id AND n.k = 1",
)
def model_neighbours(spark, sf_dir):
    """Every vector classified by its nearest other vectors."""
    points = table(spark, sf_dir, "embeddings")
    near = nearest_neighbours(points, points, _NEIGHBOURS, "vec_id", "vec_id", "embedding", exclude_self=True).persist()
    labels = points.select(F.col("vec_id").alias("neighbour_id"), "label")
    classes = points.agg(F.max("label")).first()[0] + 1
    votes = vote(near, labels, "vec_id", classes)
    first = near.where("rank = 1").select(
        "vec_id", F.col("neighbour_id").alias("nearest"), F.round("distance", 6).alias("distance")
    )
    return votes.select("vec_id", "prediction").join(first, "vec_id")


# Every model once: trained and scored on its held-out part

# Small ensembles keep a single fit short; tuning draws from the full ranges.
_QUICK = {"n_estimators": 15, "max_depth": 4}


def _model_run(name: str, task: str):
    def trained(spark, sf_dir):
        if task == "classification":
            rows, target, numbers, texts, key = _graded_documents(spark, sf_dir), "quality", _DOC_NUMBERS, _DOC_TEXTS, "doc_id"
        else:
            rows, target, numbers, texts, key = _parts(spark, sf_dir), "p_retailprice", ["p_size"], ["p_brand", "p_type"], "p_partkey"
        ready, labels = prepare_rows(rows.persist(), target, task, [key])
        train, test = split_rows(ready, task, [key], 0.2, 5)
        train, test = spread(train).persist(), spread(test).persist()
        stages = prep.fit_preprocessing(train, numbers, texts)
        vectors = stages.transform(train).select("features", "label").persist()
        facts = TrainFacts.of(vectors, task)
        params = _QUICK if any(t in name for t in ("Forest", "Boosting", "XGB", "LGBM")) else {}
        fitted = build_model(name, task, params, facts).fit(vectors)
        scored = scored_columns(fitted.transform(stages.transform(test)))
        found = evaluate(scored, task, len(labels))
        board = board_rows(spark, [{"model": name, "training_time": 0.0, "metrics": found}], task)
        return board.drop("training_time")

    return trained


for _task in ("classification", "regression"):
    for _name in list_models(_task):
        query(f"model_board_{_name}")(_model_run(_name, _task))


# Folds, tuning, whole runs

_FOLDS_SQL = (
    "WITH z AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || p_partkey)) - 1 AS p FROM part), n AS (SELECT count(*) AS n FROM part), "
    "f AS (SELECT p_partkey AS x, p_retailprice AS y, CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) "
    "ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM z, n), "
    "m AS (SELECT g.i AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM range(5) AS g(i) JOIN f ON f.fold <> g.i GROUP BY 1) "
    "SELECT CAST(f.fold AS INTEGER) AS fold, round(sqrt(avg(power(y - a - b * x, 2))), 5) AS rmse FROM f JOIN m ON m.fold = f.fold GROUP BY 1"
)


@query("cross_validation", _FOLDS_SQL)
def cross_validation(spark, sf_dir):
    """Fold scores of a linear regression whose preprocessing is learned within each fold."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("x"), F.col("p_retailprice").alias("label"))
    folded = spread(kfold(rows, ["p_partkey"])).persist()
    frames = fold_frames(folded, lambda d: prep.fit_preprocessing(d, ["x"], []), "regression", 5)
    scores = cross_validate("LinearRegression", "regression", {}, frames, "rmse", 0)
    return spark.createDataFrame([(i, round(s, 5)) for i, s in enumerate(scores)], "fold int, rmse double")


@query("tune_ridge")
def tune_ridge(spark, sf_dir):
    folded = kfold(_parts(spark, sf_dir).withColumn("label", F.col("p_retailprice")), ["p_partkey"], 3)
    folded = spread(folded).persist()
    frames = fold_frames(folded, lambda d: prep.fit_preprocessing(d, ["p_size"], ["p_brand"]), "regression", 3)
    found = tune("Ridge", "regression", frames, "rmse", trials=4, prune=False)
    rows = [(t.number, float(t.params["alpha"]), float(t.mean), t.params == found.params) for t in found.trials]
    return spark.createDataFrame(rows, "trial int, alpha double, rmse double, chosen boolean")


@query("tune_search")
def tune_search(spark, sf_dir):
    """The default search, 20 trials over five folds, of a logistic regression on the graded documents."""
    rows = _graded_documents(spark, sf_dir).withColumn("label", F.col("quality").cast("double"))
    folded = spread(stratified_kfold(rows, "label", ["doc_id"])).persist()
    frames = fold_frames(folded, lambda d: prep.fit_preprocessing(d, _DOC_NUMBERS, _DOC_TEXTS), "classification", 5)
    found = tune("LogisticRegression", "classification", frames, "f1_weighted", 2)
    rows = [(t.number, float(t.params["C"]), t.state, len(t.folds), float(t.mean), t.params == found.params) for t in found.trials]
    return spark.createDataFrame(rows, "trial int, C double, state string, folds int, f1 double, chosen boolean")


@query("train_all")
def train_models(spark, sf_dir):
    rows = _graded_documents(spark, sf_dir).persist()
    training = train_all(
        rows,
        "quality",
        "classification",
        ["LogisticRegression", "GaussianNB"],
        lambda d: prep.fit_preprocessing(d, _DOC_NUMBERS, _DOC_TEXTS),
        "f1",
        trials=2,
        folds=3,
        key=["doc_id"],
    )
    return training.board()


@query("automl_explained")
def automl_explained(spark, sf_dir):
    """A whole run with boosted trees, whose importances come from Shapley values of the best model."""
    outcome = run(
        _graded_documents(spark, sf_dir),
        {
            "dataset_settings": {"target_column": "quality", "cross_validation_folds": 3},
            "model_selection": {"list_of_models_to_train": ["XGBClassifier"]},
            "hyperparameter_optimization": {"number_of_trials": 0},
            "explainability": {"rows": None},
        },
        key=["doc_id"],
    )
    return outcome.importance


@query("automl_run")
def automl_run(spark, sf_dir):
    """Clean, build features, tune, rank and explain on the graded documents."""
    outcome = run(
        _graded_documents(spark, sf_dir),
        {
            "dataset_settings": {"target_column": "quality", "cross_validation_folds": 3},
            "feature_engineering": {"log_transform": True, "feature_interactions": True},
            "model_selection": {"list_of_models_to_train": ["LogisticRegression", "GaussianNB"]},
            "hyperparameter_optimization": {"number_of_trials": 2},
            "explainability": {"enable_shap": False},
        },
        key=["doc_id"],
    )
    return outcome.board


# Explanations

_OLS = (
    "WITH s AS (SELECT covar_pop(p_partkey, p_partkey) AS aa, covar_pop(p_size, p_size) AS bb, covar_pop(p_partkey, p_size) AS ab, "
    "covar_pop(p_partkey, p_retailprice) AS ya, covar_pop(p_size, p_retailprice) AS yb FROM part), "
    "w AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS wb FROM s)"
)
_BACKGROUND = 100

# All cuts of both columns with missing values on either side; the leaf's weight is its rows and one.
_BOOST_SQL = (
    "WITH r AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) END AS a, CAST(o_orderkey % 17 AS DOUBLE) AS b, "
    "CAST(o_totalprice / 1000 + 100 * ((o_custkey % 40) > 22)::INT + 30 * (o_orderkey % 6 = 0)::INT AS DOUBLE) AS y FROM orders), "
    "g AS (SELECT a, b, avg(y) OVER () - y AS g FROM r), "
    "l AS (SELECT 'a' AS feature, a AS v, g FROM g UNION ALL SELECT 'b', b, g FROM g), "
    "s AS (SELECT feature, v, sum(g) AS g, count(*) AS n FROM l GROUP BY ALL), "
    "t AS (SELECT feature, sum(g) AS g, sum(n) AS n, coalesce(sum(g) FILTER (v IS NULL), 0) AS mg, coalesce(sum(n) FILTER (v IS NULL), 0) AS mn FROM s GROUP BY 1), "
    "c AS (SELECT feature, v AS cut, sum(g) OVER w AS lg, sum(n) OVER w AS ln FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY v)), "
    "d AS (SELECT feature, cut, m AS missing_left, lg + CASE WHEN m THEN mg ELSE 0 END AS lg, ln + CASE WHEN m THEN mn ELSE 0 END AS ln, g, n, mn "
    "FROM c JOIN t USING (feature), (SELECT unnest([true, false]) AS m)), "
    "e AS (SELECT feature, cut, missing_left, mn, ln, n, 0.5 * (lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) - g * g / (n + 1)) AS gain FROM d WHERE ln > 0 AND ln < n) "
    "SELECT feature, cut, CASE WHEN mn > 0 THEN missing_left ELSE ln >= n - ln END AS missing_left, round(gain, 2) AS gain FROM e ORDER BY e.gain DESC LIMIT 1"
)


def _ols(spark, sf_dir):
    train = _part_vectors(spark, sf_dir, ["p_partkey", "p_size"])
    return train, build_model("LinearRegression", "regression", {}, TrainFacts.of(train, "regression")).fit(train)


@query(
    "explain_kernel_shap",
    _OLS
    + f", b AS (SELECT avg(p_partkey) AS ma, avg(p_size) AS mb FROM (SELECT * FROM part ORDER BY md5('42-' || p_partkey) LIMIT {_BACKGROUND})) "
    "SELECT p_partkey, round(wa * (p_partkey - ma), 4) AS shap_partkey, round(wb * (p_size - mb), 4) AS shap_size FROM part, w, b",
)
def explain_kernel_shap(spark, sf_dir):
    """Model-free Shapley values of a linear model, which have a closed form."""
    rows, fitted = _ols(spark, sf_dir)
    background = bounded_sample(rows, _BACKGROUND, ["p_partkey"])
    explained = kernel_shap(rows, fitted, background, "p_partkey")
    return explained.select(
        "p_partkey",
        F.round(F.col("shap")[0][0], 4).alias("shap_partkey"),
        F.round(F.col("shap")[1][0], 4).alias("shap_size"),
    )


@query(
    "explain_coefficients",
    _OLS
    + " SELECT 'x_p_partkey' AS feature, round(abs(wa), 6) AS importance FROM w UNION ALL SELECT 'x_p_size', round(abs(wb), 6) FROM w",
)
def explain_coefficients(spark, sf_dir):
    rows, fitted = _ols(spark, sf_dir)
    found = explain.top_features(explain.native_importance(spark, fitted, prep.feature_names(rows)))
    return found.select("feature", F.round("importance", 6).alias("importance"))


@query("explain_tree_shap")
def explain_tree_shap(spark, sf_dir):
    """Shapley values of a forest for every part."""
    rows = _part_vectors(spark, sf_dir, ["p_partkey", "p_size"])
    forest = build_model(
        "RandomForestRegressor", "regression", {"n_estimators": 10, "max_depth": 4}, TrainFacts.of(rows, "regression")
    ).fit(rows)
    explained = tree_shap(rows, forest)
    return explained.select(
        "p_partkey", F.col("shap")[0][0].alias("shap_partkey"), F.col("shap")[1][0].alias("shap_size")
    )


@query("boost_split", _BOOST_SQL)
def boost_split(spark, sf_dir):
    """The first split of a boosted tree over the orders' prices and dates, against a search over all cuts."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) END AS a",
        "CAST(o_orderkey % 17 AS DOUBLE) AS b",
        "CAST(o_totalprice / 1000 + 100 * ((o_custkey % 40) > 22)::INT + 30 * (o_orderkey % 6 = 0)::INT AS DOUBLE) AS label",
    )
    train = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(rows)
    (tree,) = BoostedTrees(rounds=1, maxDepth=1, rate=1.0).fit(train).forest[0]
    cut = (("a", "b")[tree["feature"][0]], float(tree["cut"][0]), bool(tree["missing_left"][0]), round(float(tree["gain"][0]), 2))
    return spark.createDataFrame([cut], "feature string, cut double, missing_left boolean, gain double")


@query("explain_forest")
def explain_forest(spark, sf_dir):
    """Mean absolute Shapley values of a forest over all graded documents."""
    rows = _graded_documents(spark, sf_dir).withColumn("label", F.col("quality").cast("double"))
    vectors = prep.fit_preprocessing(rows, _DOC_NUMBERS, _DOC_TEXTS).transform(rows)
    forest = build_model(
        "RandomForestClassifier", "classification", {"n_estimators": 10, "max_depth": 4}, TrainFacts.of(vectors, "classification")
    ).fit(vectors)
    return explain.feature_importance(vectors, forest, rows=None)
