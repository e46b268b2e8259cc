from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.models import knn
from tabwright.models.build import TrainFacts, build_model, scored_columns
from tabwright.models.catalog import list_models
from tabwright.models.kernel import KernelMap
from tabwright.models.knn import KNNClassifier
from tabwright.operators import neighbours
from tabwright.operators.explain import feature_importance, mean_absolute
from tabwright.operators.kernel_shap import kernel_shap
from tabwright.operators.metrics import evaluate
from tabwright.operators.neighbours import nearest_neighbours
from tabwright.operators.tree_shap import leaf_tables, shapley_rows, tree_shap
from tabwright.plans.run import run
from tabwright.sources.store import Store


def _vectors(spark, x, y):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names) + ", label double")
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.coalesce(1)).cache()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 240)
    centres = np.array([[0.0, 0.0, 1.0], [3.0, 0.0, -1.0], [0.0, 3.0, 0.0]])
    return _vectors(spark, centres[y] + rng.normal(size=(240, 3)) * 0.7, y)


@pytest.fixture(scope="module")
def pair(blobs):
    return blobs.where("label < 2").cache()


@pytest.fixture(scope="module")
def slope(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 3))
    return _vectors(spark, x, 2 * x[:, 0] - x[:, 1] ** 2 + 0.1 * rng.normal(size=200))


QUICK = {"n_estimators": 4, "max_depth": 3, "colsample_bytree": 0.7, "num_leaves": 31}


@pytest.mark.parametrize("name", list_models("classification"))
@pytest.mark.parametrize("kinds", [2, 3])
def test_classifiers_learn(blobs, pair, name, kinds):
    df = pair if kinds == 2 else blobs
    facts = TrainFacts.of(df, "classification")
    assert facts.classes == kinds
    scored = scored_columns(build_model(name, "classification", QUICK, facts).fit(df).transform(df))
    found = evaluate(scored, "classification", kinds)
    assert found["accuracy"] > 0.85 and found["roc_auc"] > 0.9
    sums = scored.select(F.aggregate("scores", F.lit(0.0), lambda a, v: a + v).alias("s"), F.size("scores").alias("n"))
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == kinds for r in sums.collect())


@pytest.mark.parametrize("name", list_models("regression"))
def test_regressors_learn(slope, name):
    facts = TrainFacts.of(slope, "regression")
    params = {"alpha": 0.01} if name in ("Ridge", "Lasso") else {**QUICK, "C": 100.0}
    params["n_estimators"] = 20
    scored = scored_columns(build_model(name, "regression", params, facts).fit(slope).transform(slope))
    assert evaluate(scored, "regression")["r2"] > 0.5


def test_ridge_matches_the_normal_equations(slope):
    table = slope.select("x0", "x1", "x2", "label").toPandas().to_numpy()
    x, y = table[:, :3] - table[:, :3].mean(axis=0), table[:, 3] - table[:, 3].mean()
    expected = np.linalg.solve(x.T @ x + 7.0 * np.eye(3), x.T @ y)
    fitted = build_model("Ridge", "regression", {"alpha": 7.0}, TrainFacts.of(slope, "regression")).fit(slope)
    np.testing.assert_allclose(fitted.coefficients.toArray(), expected, rtol=1e-6)


def test_kernel_map_approximates_the_kernel(blobs):
    table = np.stack([r["v"] for r in blobs.select(vector_to_array("features").alias("v")).collect()])
    d = ((table[:40, None] - table[None, :40]) ** 2).sum(axis=2)
    for kernel, exact in (("rbf", np.exp(-0.2 * d)), ("poly", (0.2 * table[:40] @ table[:40].T) ** 3)):
        model = KernelMap(inputCol="features", outputCol="m", kernel=kernel, gamma="0.2", components=4096).fit(blobs)
        m = np.stack([r["m"].toArray() for r in model.transform(blobs).select("m").limit(40).collect()])
        assert np.abs(m @ m.T - exact).max() < 0.15 * max(1, np.abs(exact).max())
    with pytest.raises(ValueError, match="is not known"):
        KernelMap(inputCol="features", outputCol="m", kernel="cubic").fit(blobs)


def _brute(x, k):
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("train_block, query_block", [(4096, 512), (16, 8)])
def test_neighbours_are_exact_with_a_third_of_the_rows_equal(spark, monkeypatch, train_block, query_block):
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", train_block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:100] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    rows = nearest_neighbours(df, df, 5, "id", "id", "v", exclude_self=True).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        found.setdefault(r["id"], []).append(r["neighbour_id"])
    assert [found[i] for i in range(300)] == _brute(x, 5)


def test_queries_are_sent_once_for_each_share(spark, monkeypatch):
    """However many cells a query visits, the shares of the training rows bound how often it is sent."""

    def met(k, exclude_self):
        def run(asked, train):
            rows = asked.num_rows
            return pa.table({"id": asked.column("id"), "neighbour_id": np.full(rows, train.num_rows), "distance": np.zeros(rows)})

        return run

    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 4)
    monkeypatch.setattr(neighbours, "_best_of_share", met)
    x = np.random.default_rng(3).normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    rows = nearest_neighbours(df, df, 399, "id", "id", "v").groupBy("id").agg(F.count("*").alias("sent"), F.sum("neighbour_id").alias("seen")).collect()
    assert len(rows) == 400
    assert all(r["sent"] == neighbours.SHARES and r["seen"] == 400 for r in rows)


def test_neighbour_model_bounds_its_distances(blobs, monkeypatch):
    assert knn.query_chunk(100) == knn.QUERY_CHUNK
    for rows in (10_000, 1_400_000, 5_000_000):
        assert knn.query_chunk(rows) * rows * 8 <= knn.DISTANCE_BYTES
    model = KNNClassifier(k=7).fit(blobs.where("id % 3 <> 0"))
    asked = blobs.where("id % 3 = 0").orderBy("id")
    whole = [(r.prediction, r.probability) for r in model.transform(asked).collect()]
    monkeypatch.setattr(knn, "DISTANCE_BYTES", 1)
    assert knn.query_chunk(100) == 1
    assert [(r.prediction, r.probability) for r in model.transform(asked).collect()] == whole


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbour_model_gives_the_same_on_both_paths(blobs, tmp_path, weights):
    model = KNNClassifier(k=7, weights=weights).fit(blobs.where("id % 3 <> 0"))
    asked = blobs.where("id % 3 = 0")
    near = {r["id"]: (r["prediction"], r["probability"]) for r in model.transform(asked).collect()}
    joined = model.copy({model.broadcastBytes: 0})
    far = {r["id"]: (r["prediction"], r["probability"]) for r in joined.transform(asked).collect()}
    assert near.keys() == far.keys()
    for i in near:
        assert near[i][0] == far[i][0]
        np.testing.assert_allclose(near[i][1].toArray(), far[i][1].toArray(), atol=1e-12)
    PipelineModel([model]).write().overwrite().save(f"{tmp_path}/knn")
    again = PipelineModel.load(f"{tmp_path}/knn").transform(asked)
    assert {r["id"]: r["prediction"] for r in again.collect()} == {i: p for i, (p, _) in near.items()}


def _forest_value(nodes_value, x, known):
    """Expected leaf value when only the features in ``known`` are followed."""
    tables, outputs, base = nodes_value
    total = base * 0
    for t in tables:
        for f, lo, hi, z, v in zip(*t):
            share = 1.0
            for j in range(len(f)):
                share *= float(lo[j] < x[f[j]] <= hi[j]) if f[j] in known else z[j]
            total = total + share * v
    return total


@pytest.mark.parametrize("name", ["RandomForestClassifier", "RandomForestRegressor", "GradientBoostingRegressor"])
def test_tree_shap_matches_the_definition(spark, blobs, slope, name):
    df = blobs if name.endswith("Classifier") else slope
    task = "classification" if name.endswith("Classifier") else "regression"
    fitted = build_model(name, task, {"n_estimators": 4, "max_depth": 4}, TrainFacts.of(df, task)).fit(df)
    tables = leaf_tables(fitted, spark)
    x = np.array(df.select(vector_to_array("features")).first()[0])
    expected = np.zeros((3, tables[1]))
    for j in range(3):
        others = [f for f in range(3) if f != j]
        for size in range(3):
            for s in combinations(others, size):
                weight = factorial(size) * factorial(2 - size) / factorial(3)
                expected[j] += weight * (_forest_value(tables, x, {*s, j}) - _forest_value(tables, x, set(s)))
    np.testing.assert_allclose(shapley_rows(x[None, :], tables[0], tables[1])[0], expected, atol=1e-10)

    out, base = tree_shap(fitted.transform(df), fitted), tables[2]
    value = vector_to_array("probability") if task == "classification" else F.array("prediction")
    for r in out.select("shap", value.alias("value")).limit(20).collect():
        np.testing.assert_allclose(np.sum(r["shap"], axis=0) + base, r["value"], atol=1e-8)


@pytest.mark.parametrize("coalitions", [None, 40])
def test_kernel_shap_adds_up(pair, coalitions):
    fitted = build_model("LogisticRegression", "classification", {}, TrainFacts.of(pair, "classification")).fit(pair)
    rows = pair.limit(30).cache()
    out = kernel_shap(rows, fitted, pair.limit(20), "id", coalitions=coalitions)
    scored = fitted.transform(rows).select("id", vector_to_array("probability").alias("p"))
    joined = out.join(scored, "id").collect()
    assert len(joined) == 30
    for r in joined:
        np.testing.assert_allclose(np.sum(r["shap"], axis=0) + r["base"], r["p"], atol=1e-9)
    assert mean_absolute(out, ["a", "b", "c"]).count() == 3


def test_importance_ranks_the_driving_feature_first(slope):
    facts = TrainFacts.of(slope, "regression")
    forest = build_model("RandomForestRegressor", "regression", {"n_estimators": 10, "max_depth": 4}, facts).fit(slope)
    linear = build_model("LinearRegression", "regression", {}, facts).fit(slope)
    for fitted in (forest, linear):
        rows = feature_importance(slope, fitted, top_k=2, rows=50).collect()
        assert len(rows) == 2 and rows[0]["feature"] == "x0" and rows[0]["importance"] > rows[1]["importance"]


@pytest.mark.parametrize("encoding, fit_on, method", [("onehot", "all", "iqr"), ("label", "train", "zscore")])
def test_whole_run_is_saved_and_scores_new_rows(spark, tmp_path, encoding, fit_on, method):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        a, b = float(rng.normal()), float(rng.normal())
        kind = ["red", "blue", None][int(rng.integers(3))]
        rows.append((a if i % 11 else None, b, kind, "yes" if a + (kind == "red") > 0 else "no" if i % 40 else None))
    df = spark.createDataFrame(rows, "a double, b double, kind string, y string")
    store = Store(spark, str(tmp_path))
    outcome = run(
        df,
        {
            "dataset_settings": {"cross_validation_folds": 3},
            "data_cleaning": {"categorical_encoding": encoding},
            "outlier_removal": {"method": method},
            "feature_engineering": {"feature_interactions": True},
            "model_selection": {"list_of_models_to_train": ["GaussianNB", "LogisticRegression"]},
            "hyperparameter_optimization": {"number_of_trials": 2},
            "training_strategy": {"fit_on": fit_on},
            "explainability": {"rows": 20},
        },
        store,
    )
    state = store.run(outcome.run_id)
    assert (state["status"], state["progress"], state["problem_type"]) == ("completed", 100.0, "classification")
    board = store.board(outcome.run_id).collect()
    assert len(board) == 2 and board[0]["accuracy"] >= board[1]["accuracy"] and board[0]["accuracy"] > 0.7
    assert state["best_model"] == board[0]["model"] == store.report(outcome.run_id)["best_model"]
    assert store.importance(outcome.run_id).count() > 2
    new = outcome.training.test.drop("label", "prediction")
    predicted = store.load_model(outcome.run_id).transform(new).select("predicted").collect()
    assert {r["predicted"] for r in predicted} <= {"yes", "no"}


def test_an_ended_run_goes_on_with_the_next_model(spark, tmp_path, monkeypatch):
    from tabwright.plans import train

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), "yes" if a + b / 3 > 0 else "no") for a, b in rng.normal(size=(160, 2))], "a double, b double, y string")
    config = {
        "dataset_settings": {"cross_validation_folds": 2},
        "model_selection": {"list_of_models_to_train": ["GaussianNB", "LogisticRegression"]},
        "hyperparameter_optimization": {"number_of_trials": 2},
        "explainability": {"enable_shap": False},
    }
    store, plain, fitted = Store(spark, str(tmp_path)), train.build_model, []

    def lost(name, *rest):
        if name == "LogisticRegression":
            raise SystemExit("the driver is gone")
        return plain(name, *rest)

    monkeypatch.setattr(train, "build_model", lost)
    with pytest.raises(SystemExit):
        run(df, config, store)
    run_id = store.current_run()["run_id"]
    assert store.run(run_id)["status"] == "running" and list(store.trained(run_id, 2)) == [0]

    def counted(name, *rest):
        fitted.append(name)
        return plain(name, *rest)

    monkeypatch.setattr(train, "build_model", counted)
    outcome = run(df, None, store, resume=run_id)
    assert fitted == ["LogisticRegression"] and outcome.run_id == run_id
    assert store.run(run_id)["status"] == "completed" and store.board(run_id).count() == 2
    assert [t["model"] for t in store.report(run_id)["trained"]] == ["GaussianNB", "LogisticRegression"]
    again = run(df, config, Store(spark, f"{tmp_path}/other"))
    scores = lambda o: {r.model: (r.metrics, r.params) for r in o.training.results}
    assert scores(again) == scores(outcome)
    with pytest.raises(ValueError, match="no run"):
        run(df, None, store, resume=run_id)


def test_failed_run_is_recorded(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no column z"):
        run(spark.range(20), {"dataset_settings": {"target_column": "z"}}, store)
    assert store.current_run()["status"] == "failed" and "no column z" in store.current_run()["message"]


@pytest.mark.parametrize("whole", [False, True])
def test_training_spreads_the_rows_of_few_files(spark, tmp_path, monkeypatch, whole):
    """A model sees even partitions, whether it is trained alone or among others."""
    from catalogue import QUERIES, modelling
    from tabwright.functions.small import TASK_ROWS
    from tabwright.operators import prep
    from tabwright.plans import train

    class Seen(Exception):
        pass

    class Stub:
        def fit(self, vectors):
            raise Seen(vectors.rdd.getNumPartitions())

    for module in (modelling, train):
        monkeypatch.setattr(module, "build_model", lambda *_: Stub())
    rows = spark.range(2 * TASK_ROWS).coalesce(1).selectExpr(
        "id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "CONCAT('b', id % 3) AS p_brand", "CONCAT('t', id % 2) AS p_type", "id % 9 + 0.5D AS p_retailprice"
    )
    with pytest.raises(Seen) as seen:
        if whole:
            train.train_all(rows, "p_retailprice", "regression", ["Ridge"], lambda d: prep.fit_preprocessing(d, ["p_size"], ["p_brand"]), trials=0, key=["p_partkey"])
        else:
            rows.write.parquet(f"{tmp_path}/part.parquet")
            QUERIES["model_board_SVR"](spark, str(tmp_path))
    assert seen.value.args[0] >= 2
