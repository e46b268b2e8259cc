import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import meta, profile
from tabwright.operators.metrics import check_metric
from tabwright.models.catalog import draw_params, list_models, models_by_task
from tabwright.models.build import TrainFacts, build_model
from tabwright.plans.settings import DEFAULTS, merged


def test_missing_table_counts_nulls_only(mixed):
    rows = {r["column"]: r["missing_count"] for r in profile.missing_by_column(mixed).collect()}
    nulls = mixed.where("f3 IS NULL").count()
    assert rows["f1"] == 10 and rows["f2"] == 7 and rows["f3"] == nulls
    assert "id" not in rows and "target" not in rows


def test_describe_matches_pandas(mixed):
    table = mixed.select("f1", "f2").toPandas().describe().round(4)
    for r in profile.describe_numeric(mixed, ["f1", "f2"]).collect():
        assert r["value"] == pytest.approx(table.loc[r["stat"], r["column"]], abs=1e-4)


def test_describe_text_of_an_empty_column(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "x string, y string")
    rows = {r["column"]: r for r in profile.describe_text(df).collect()}
    assert (rows["x"]["count"], rows["x"]["unique"], rows["x"]["top"], rows["x"]["freq"]) == (2, 1, "a", 2)
    assert (rows["y"]["count"], rows["y"]["unique"]) == (0, 0)


def test_correlation_is_pairwise_complete_and_safe_on_constants(mixed):
    df = mixed.select("f1", "f2", "target", F.lit(3).alias("flat"))
    expected = df.toPandas().astype(float).corr().fillna(0)
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation(df).collect()}
    assert len(found) == 16
    for (a, b), value in found.items():
        assert value == pytest.approx(expected.loc[a, b], abs=1e-4)


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x"), (2, None), (1, None)], "a int, b string")
    assert profile.duplicate_rows(df).first()[0] == 2


def test_duplicates_with_a_large_hash_set(spark, monkeypatch):
    monkeypatch.setattr(profile, "DUPLICATE_HASHES", 1)
    df = spark.range(100).select((F.col("id") % 30).alias("v"))
    assert profile.duplicate_rows(df).first()[0] == 70


@pytest.mark.parametrize("values, task", [(20, "classification"), (21, "regression")])
def test_problem_type_threshold(spark, values, task):
    df = spark.range(400).select((F.col("id") % values).alias("y"))
    assert profile.problem_type(df, "y") == task


def test_problem_type_of_text_and_many_rows(spark):
    df = spark.range(3000).select((F.col("id") % 100).alias("y"), F.col("id").cast("string").alias("t"))
    assert profile.problem_type(df, "y") == "classification"
    assert profile.problem_type(df, "t") == "classification"
    assert profile.problem_type(df, "t", "regression") == "regression"
    with pytest.raises(ValueError, match="no column z"):
        profile.problem_type(df, "z")


def test_bounded_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    first = {r[0] for r in profile.bounded_sample(df, 700, ["id"]).collect()}
    again = {r[0] for r in profile.bounded_sample(df.repartition(5), 700, ["id"]).collect()}
    assert len(first) == 700 and first == again


def test_whole_profile(mixed):
    found = profile.profile(mixed.drop("id"))
    assert found["target"] == "target" and found["problem_type"] == "classification"
    assert found["n_rows"] == 100 and found["n_features"] == 3
    assert found["feature_types"] == {"numerical": ["f1", "f2"], "categorical": ["f3"]}
    assert found["n_classes"] == 2 and sum(found["class_distribution"].values()) == pytest.approx(1)
    assert found["correlation_matrix"]["f1"]["f1"] == 1.0
    assert '"duplicate_rows": 0' in profile.profile_json(mixed.drop("id"))


def test_advice_on_a_small_unbalanced_table(spark):
    df = spark.range(50).select("id", (F.col("id") > 3).cast("string").alias("y"))
    titles = [r["title"] for r in profile.advice(df, "y").orderBy("seq").collect()]
    assert titles == ["No Missing Values Detected", "Class Imbalance Detected", "Small Dataset"]


def test_difficulty_of_a_balanced_table(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), (F.col("id") % 2).alias("y"))
    row = meta.meta_features(df, "y").first()
    assert row["missing_ratio"] == 0 and row["class_imbalance_ratio"] == 1 and row["outlier_ratio"] == 0
    assert row["difficulty_score"] == pytest.approx(0.2 * 0.9 + 0.2 * (1 / 1000 * 10))


def test_class_imbalance_counts_null_as_a_class(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [(None,)], "y string")
    assert meta.class_imbalance(df, "y") == 6.0
    one = spark.createDataFrame([("a",)] * 6 + [(None,)], "y string")
    assert meta.class_imbalance(one, "y") == 1.0


def test_recommendation_of_a_small_table(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).alias("y"))
    picks = meta.recommend(df, "y", "classification")
    assert picks[:3] == ["LogisticRegression", "RandomForestClassifier", "SVC"] and len(set(picks)) == 5
    assert meta.resolve_models(df, "y", "classification", ["GaussianNB"]) == ["GaussianNB"]
    with pytest.raises(ValueError, match="unknown"):
        meta.resolve_models(df, "y", "classification", ["Ridge"])


def test_catalogue():
    assert len(models_by_task()["classification"]) == 8 and len(models_by_task()["regression"]) == 8
    assert list_models("regression") == sorted(list_models("regression"))
    with pytest.raises(ValueError, match="unknown model"):
        build_model("NonExistentModel", "classification", {}, TrainFacts(10))


def test_draws_are_seeded_and_in_range():
    draws = draw_params("RandomForestClassifier", 50, 42)
    assert draws == draw_params("RandomForestClassifier", 50, 42)
    assert all(80 <= d["n_estimators"] <= 400 and 3 <= d["max_depth"] <= 18 for d in draws)
    assert all(1e-3 <= d["C"] <= 100 for d in draw_params("SVC", 50, 1))
    assert draw_params("GaussianNB", 50, 42) == [{}]


def test_settings_are_merged_without_changing_the_defaults():
    config = merged({"dataset_settings": {"target_column": "y"}})
    assert config["dataset_settings"]["target_column"] == "y"
    assert config["dataset_settings"]["cross_validation_folds"] == 5
    assert DEFAULTS["dataset_settings"]["target_column"] is None


def test_metric_names():
    assert check_metric(None, "regression") == "rmse" and check_metric("F1 score", "classification") == "f1_weighted"
    with pytest.raises(ValueError, match="does not suit"):
        check_metric("accuracy", "regression")
