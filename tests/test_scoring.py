import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import ordering, small
from tabwright.operators import board, metrics, split
from tabwright.sources.store import Store, latest


@pytest.fixture(scope="module")
def classes(spark):
    """A class with a third of the rows, two others, a single row, and null."""
    kind = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, "single").when(F.col("id") % 50 == 2, None)
    return spark.range(997).select("id", kind.otherwise(F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("k")).cache()


def test_holdout_is_exact_and_repeatable(classes):
    first = split.holdout_split(classes, ["id"], 0.2)
    assert first.where("is_test").count() == math.ceil(0.2 * 997)
    chosen = {r["id"] for r in first.where("is_test").collect()}
    assert chosen == {r["id"] for r in split.holdout_split(classes.repartition(7), ["id"], 0.2).where("is_test").collect()}
    assert chosen != {r["id"] for r in split.holdout_split(classes, ["id"], 0.2, seed=1).where("is_test").collect()}


@pytest.mark.parametrize("broadcast_rows", [100_000, 1])
def test_stratified_split_keeps_proportions(classes, monkeypatch, broadcast_rows):
    monkeypatch.setattr(small.local_copy, "__defaults__", (broadcast_rows,))
    monkeypatch.setattr(small.broadcast_if_small, "__defaults__", (broadcast_rows,))
    marked = split.stratified_split(classes, "k", ["id"], 0.2).cache()
    assert marked.count() == 997 and marked.where("is_test").count() == math.ceil(0.2 * 997)
    share = marked.groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in share:
        assert abs(r["t"] - 0.2 * r["n"]) <= 1
        if r["k"] == "single":
            assert r["t"] == 0


def test_kfold_sizes(classes):
    sizes = [r["count"] for r in split.kfold(classes, ["id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [200, 200, 199, 199, 199]


def test_stratified_folds_are_level(classes):
    folded = split.stratified_kfold(classes, "k", ["id"], 5).cache()
    totals = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(totals) == 5 and sum(totals) == 997 and max(totals) - min(totals) <= 1
    per_class = folded.groupBy("k", "fold").count().toPandas()
    for _, part in per_class.groupby("k", dropna=False):
        assert part["count"].max() - part["count"].min() <= 1


def _auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("one_task_rows", [1_000_000, 20])
def test_auc_matches_all_pairs(spark, monkeypatch, one_task_rows):
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", one_task_rows)
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "hit boolean, score double")
    assert metrics.roc_auc(df, "hit", "score").first()[0] == pytest.approx(_auc(y, s))


def test_auc_one_vs_rest(spark):
    rng = np.random.default_rng(6)
    y, s = rng.integers(0, 3, 300), np.round(rng.random((300, 3)), 2)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, s)], "label int, scores array<double>")
    expected = sum(_auc((y == k).astype(int), s[:, k]) * (y == k).mean() for k in range(3))
    assert metrics.roc_auc_one_vs_rest(df, "label", "scores").first()[0] == pytest.approx(expected)
    assert metrics.roc_auc_one_vs_rest(df.where("label < 2"), "label", "scores").first()[0] is None


def test_auc_of_a_single_class_is_null(spark):
    df = spark.createDataFrame([(True, 0.3), (True, 0.7)], "hit boolean, score double")
    assert metrics.roc_auc(df, "hit", "score").first()[0] is None


def test_classification_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 0)], "label int, prediction int")
    row = metrics.classification_metrics(df).first()
    assert row["accuracy"] == pytest.approx(0.5) and row["recall_weighted"] == pytest.approx(0.5)
    assert row["precision_weighted"] == pytest.approx((3 * 2 / 3 + 1 / 3) / 6)
    assert row["f1_weighted"] == pytest.approx((3 * 2 / 3 + 1 * 0.5) / 6)


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert (row["mse"], row["mae"]) == (pytest.approx(5 / 3), 1.0) and row["r2"] == pytest.approx(1 - 5 / 8)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert metrics.regression_metrics(flat).first()["r2"] == 1.0


def test_board_order_and_best(spark):
    results = [
        {"model": "slow", "training_time": 9.004, "metrics": {"accuracy": 0.9, "f1_weighted": 0.8}},
        {"model": "fast", "training_time": 1.0, "metrics": {"accuracy": 0.9, "f1_weighted": 0.8}},
        {"model": "none", "training_time": 0.1, "metrics": {}},
        {"model": "weak", "training_time": 0.5, "metrics": {"accuracy": 0.2, "f1_weighted": 0.9}},
    ]
    rows = board.board_rows(spark, results, "classification")
    assert [r["model"] for r in board.leaderboard(rows, "accuracy").collect()] == ["fast", "slow", "weak", "none"]
    assert board.leaderboard(rows, "f1").first()["model"] == "weak"
    best = board.best_model(rows, "accuracy").first()
    assert (best["model"], best["metric_name"], best["metric_value"]) == ("fast", "accuracy", 0.9)
    assert board.display(rows, "accuracy", 2).count() == 2
    errors = board.board_rows(
        spark, [{"model": m, "training_time": 1, "metrics": {"rmse": v}} for m, v in (("a", 3.0), ("b", 2.0))], "regression"
    )
    assert board.leaderboard(errors, "rmse").first()["model"] == "b"


def test_store_keeps_the_last_state(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.run("nothing") is None and store.current_run() is None
    data = store.register_dataset("some/path", {"n_rows": 3})
    assert store.dataset(data)["profile"] == {"n_rows": 3} and store.dataset("other") is None
    first, second = store.start_run(data), store.start_run(data)
    store.update_run(first, status="running", progress=45.0)
    store.update_run(first, status="completed", metrics={"accuracy": 1.0})
    state = store.run(first)
    assert (state["status"], state["progress"], state["dataset_id"]) == ("completed", 45.0, data)
    assert store.current_run()["run_id"] == first
    assert {r["run_id"]: r["status"] for r in store.runs().collect()} == {first: "completed", second: "queued"}
    assert store.exports(second) == {} and set(store.exports(first)) == {"pipeline", "report", "leaderboard", "importance"}


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    run_id = one.start_run("data")
    one.update_run(run_id, status="running", progress=5.0)
    two.update_run(run_id, message="from two", best_score=0.5)
    one.update_run(run_id, progress=15.0)
    two.update_run(run_id, best_score=None)
    expected = {"status": "running", "progress": 15.0, "message": "from two", "best_score": None, "dataset_id": "data"}
    state = one.run(run_id)
    assert {k: state[k] for k in expected} == expected
    files = lambda: len(list((tmp_path / "runs").glob("*.parquet")))
    assert files() == 5 and one.compact(9) == 0
    assert one.compact() == 5 and files() == 1
    assert two.run(run_id) == state and two.current_run() == state
    late = Store(spark, str(tmp_path))
    late.update_run(run_id, status="completed")
    assert one.run(run_id)["status"] == "completed" and one.run(run_id)["message"] == "from two"
    with pytest.raises(ValueError, match="no field stat"):
        one.update_run(run_id, stat="x")
    assert Store(spark, f"{tmp_path}/none").compact() == 0


def test_an_older_change_read_later_does_not_win(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    run_id = store.start_run()
    store.update_run(run_id, status="completed")
    store.compact()
    slow = Store(spark, str(tmp_path))
    monkeypatch.setattr("tabwright.sources.store.time.time_ns", lambda: 5)  # a writer that began long ago
    slow.update_run(run_id, status="running", message="old")
    assert store.run(run_id)["status"] == "completed" and store.run(run_id)["message"] == "Waiting"


def test_latest_of_a_busy_key(spark):
    log = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), "id", (F.col("id") * 2).alias("v"))
    assert {r["k"]: r["v"] for r in latest(log, ["k"], "id").collect()} == {True: 1998, False: 1996}
