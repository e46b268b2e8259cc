import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import encode, features, prep, select
from tabwright.operators.outliers import remove_outliers
from tabwright.functions import small
from tabwright.sources import load as loading


@pytest.fixture(scope="module")
def spiky(spark):
    rows = [(i, float(i % 10), 5.0, None, "t") for i in range(200)] + [(200, 900.0, 5.0, None, "t"), (201, None, 5.0, None, "t")]
    return spark.createDataFrame(rows, "id bigint, v double, flat double, empty double, y string").cache()


@pytest.mark.parametrize("method", ["zscore", "iqr", "isolation_forest"])
def test_outliers_go_and_gaps_stay(spiky, method):
    kept = {r["id"] for r in remove_outliers(spiky, "y", method, key=["id"], contamination=0.01).collect()}
    assert 200 not in kept and 201 in kept


@pytest.mark.parametrize("method", ["none", "something else"])
def test_unknown_method_keeps_all(spiky, method):
    assert remove_outliers(spiky, "y", method).count() == 202


def test_outliers_without_numbers(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert remove_outliers(df, "y", "iqr").count() == 1


def test_isolation_forest_share(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(3000)], "id bigint, a double, b double")
    kept = remove_outliers(df, None, "isolation_forest", key=["id"])
    assert kept.count() == 2850
    far = lambda d: d.agg(F.avg(F.col("a") ** 2 + F.col("b") ** 2)).first()[0]
    assert far(kept) < far(df)
    assert {r["id"] for r in kept.collect()} == {
        r["id"] for r in remove_outliers(df.repartition(5), None, "isolation_forest", key=["id"]).collect()
    }


def test_log_shifts_columns_that_are_not_positive(spark):
    df = spark.createDataFrame([(-2.0, 1.0), (3.0, None)], "a double, b double")
    rows = features.log_transform(df, features.fit_log_shift(df, ["a", "b"])).collect()
    assert rows[0]["a"] == pytest.approx(np.log(2)) and rows[1]["a"] == pytest.approx(np.log(7))
    assert rows[0]["b"] == pytest.approx(np.log(2)) and rows[1]["b"] is None


def test_polynomial_names_and_order(spark):
    df = spark.createDataFrame([(2.0, "k", 3.0)], "a double, t string, b double")
    built = features.polynomial_features(df, ["a", "b"])
    assert built.columns == ["t", "a", "b", "a^2", "a b", "b^2"]
    assert list(built.first())[1:] == [2.0, 3.0, 4.0, 6.0, 9.0]


def test_interactions_use_the_first_eight_and_skip_taken_names(spark):
    df = spark.range(1).select(*[F.lit(i + 1).alias(f"c{i}") for i in range(9)], F.lit(0).alias("c0__x__c1"))
    built = features.interaction_features(df, [f"c{i}" for i in range(9)])
    assert len(built.columns) == 10 + 27 and built.first()["c0__x__c1"] == 0
    assert "c0__x__c8" not in built.columns


@pytest.mark.parametrize("broadcast_rows", [100_000, 1])
def test_label_codes(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(small.local_copy, "__defaults__", (broadcast_rows,))
    monkeypatch.setattr(small.broadcast_if_small, "__defaults__", (broadcast_rows,))
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "a", "x")], "id int, p string, q string")
    rows = {r["id"]: (r["p"], r["q"]) for r in encode.label_encode(df).collect()}
    assert rows == {1: (1, 0), 2: (-1, 1), 3: (0, 0)}
    unseen = spark.createDataFrame([(9, "zzz", "y")], "id int, p string, q string")
    assert list(encode.label_encode(unseen, ["p", "q"], encode.level_codes(df, ["p", "q"])).first()) == [9, -1, 1]


def test_variance_selection(spark):
    df = spark.createDataFrame([(1.0, 5, None, "s", "u"), (2.0, 5, None, "s", None)], "a double, b int, c double, d string, e string")
    assert select.varying_columns(df, df.columns) == ["a", "e"]


def test_information_finds_the_informative_column(spark):
    df = spark.range(2000).select(
        (F.col("id") % 4).cast("double").alias("good"),
        F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("noise"),
        F.when(F.col("id") % 4 < 2, "p").otherwise("q").alias("y"),
    )
    rows = {r["feature"]: r["mi"] for r in select.mutual_information(df, "y", ["good", "noise"], "classification").collect()}
    assert rows["good"] == pytest.approx(np.log(2), abs=1e-9) and rows["noise"] < 0.05
    assert select.select_features(df, "y", "mutual_information", 1) == ["good"]
    assert select.select_features(df, "y", "recursive_feature_elimination", 1) == ["good"]
    assert select.select_features(df, "y", "other", 99) == ["good", "noise"]
    assert select.clamp_k(0, 5) == 1 and select.clamp_k(None, 50) == 20


def test_engineering_leaves_the_key_alone(mixed):
    config = {
        "log_transform": True,
        "polynomial_features": True,
        "feature_interactions": True,
        "feature_selection": {"enabled": True, "method": "mutual_information", "k_features": 3},
    }
    built = features.engineer_features(mixed, "target", config, "classification", ["id"])
    assert built.columns[0] == "id" and built.columns[-1] == "target" and len(built.columns) == 5
    assert {r["id"] for r in built.collect()} == set(range(100))


def _vectors(model, df):
    return [list(r[0]) for r in model.transform(df).orderBy("id").select(vector_to_array("features")).collect()]


def test_preprocessing_fills_scales_and_encodes(spark, tmp_path):
    train = spark.createDataFrame(
        [(1, 1.0, 4.0, "it's", True), (2, None, 4.0, "b\\c", False), (3, 3.0, 4.0, "it's", True)],
        "id int, `a.b` double, `flat col` double, kind string, flag boolean",
    )
    model = prep.fit_preprocessing(train, ["a.b", "flat col", "flag"], ["kind"])
    vectors = _vectors(model, train)
    spread = np.sqrt(2 / 3)
    np.testing.assert_allclose([v[0] for v in vectors], [-1 / spread, 0, 1 / spread])
    assert [v[1] for v in vectors] == [0, 0, 0]
    assert [v[3:] for v in vectors] == [[0, 1], [1, 0], [0, 1]]
    names = prep.feature_names(model.transform(train))
    assert names == ["num__a_b", "num__flat col", "num__flag", "cat__kind_b\\c", "cat__kind_it's"]

    new = spark.createDataFrame([(9, 5.0, None, "unseen", None)], train.schema)
    assert _vectors(model, new)[0][3:] == [0, 0] and _vectors(model, new)[0][1] == 0
    model.write().overwrite().save(f"{tmp_path}/prep")
    assert _vectors(PipelineModel.load(f"{tmp_path}/prep"), new) == _vectors(model, new)


def test_minmax_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 7.0), (2, 4.0, 7.0)], "id int, a double, b double")
    assert _vectors(prep.fit_preprocessing(df, ["a", "b"], [], scaling="minmax"), df) == [[0, 0], [1, 0]]
    assert _vectors(prep.fit_preprocessing(df, ["a", "b"], [], scaling="none"), df) == [[2, 7], [4, 7]]


def test_imputation_rules(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, None), (2.0, None), (9.0, None), (None, None)], "a double, b double")
    assert prep.fit_fill(df, ["a", "b"], "most_frequent") == {"a": 1.0}
    assert prep.fit_fill(df, ["a", "b"], "median") == {"a": 2.0}
    assert prep.fit_fill(df, ["a", "b"], "mean") == {"a": 3.0}
    assert prep.fit_fill(df, ["a", "b"], "constant") == {"a": 0.0, "b": 0.0}
    assert prep.fit_fill(df, ["a"], "drop") == {"a": 1.0}
    with pytest.raises(ValueError, match="unknown missing value strategy"):
        prep.fit_fill(df, ["a"], "guess")


def test_too_many_levels_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError, match="too many levels"):
        prep.fit_levels(df, ["k"], max_levels=10)


def test_target_codes_sort_numbers_as_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (100,), (None,)], "y int")
    labels = encode.target_labels(df, "y")
    assert labels == ["9", "10", "100"]
    rows = encode.target_indexer(labels, "y").transform(df.na.drop()).collect()
    assert {r["y"]: r["label"] for r in rows} == {9: 0.0, 10: 1.0, 100: 2.0}


def test_csv_types_and_missing_texts(spark, tmp_path):
    text = 'whole,gaps,real,flag,name,big\n1,2,1.5,True,"a, ""b""",99999999999999999999\n2,NA,nan,False,null,1\n3,4,1e3,True,1d,2\n'
    (tmp_path / "t.csv").write_text(text)
    df = loading.load(spark, f"{tmp_path}/t.csv")
    assert dict(df.dtypes) == {
        "whole": "bigint", "gaps": "double", "real": "double", "flag": "boolean", "name": "string", "big": "double",
    }
    rows = [list(r) for r in df.collect()]
    assert rows[0][:5] == [1, 2.0, 1.5, True, 'a, "b"'] and rows[1][1:3] == [None, None] and rows[1][4] is None
    assert rows[2][4] == "1d"
    given = loading.load(spark, f"{tmp_path}/t.csv", schema="whole double, gaps int, real double, flag string, name string, big string")
    assert dict(given.dtypes)["gaps"] == "int" and given.collect()[1]["gaps"] is None
    with pytest.raises(ValueError, match="unsupported format"):
        loading.load(spark, "x.pkl")


def test_row_checks(spark):
    with pytest.raises(ValueError, match="empty"):
        loading.check_rows(spark.range(0))
    with pytest.raises(ValueError, match="needs at least 10"):
        loading.check_rows(spark.range(9))
    with pytest.raises(ValueError, match="needs at least 20"):
        loading.check_rows(spark.range(19), folds=10)
    loading.check_rows(spark.range(10), folds=5)
    with pytest.raises(ValueError, match="nested"):
        loading.check_types(spark.range(1).select(F.array("id").alias("a")))


def test_quoted_line_breaks_and_surplus_fields(spark, tmp_path):
    folder = tmp_path / "quoted"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"",\nok"\n3,plain\n4\n')
    assert loading.open_quotes(spark, str(folder))
    rows = loading.load(spark, str(folder), "csv").collect()
    assert sorted(map(tuple, rows)) == [(1, "x\ny"), (2, 'say "hi",\nok'), (3, "plain"), (4, None)]
    (tmp_path / "one.csv").write_text('a,b\n1,"x ""y"" z"\n2,u\n')
    assert not loading.open_quotes(spark, f"{tmp_path}/one.csv")  # still cut into parts
    assert [tuple(r) for r in loading.load(spark, f"{tmp_path}/one.csv").collect()] == [(1, 'x "y" z'), (2, "u")]
    (tmp_path / "wide.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="has more than 2 fields; it begins with 3"):
        loading.load(spark, f"{tmp_path}/wide.csv")
    with pytest.raises(Exception, match="has more than 2 fields"):
        loading.load(spark, f"{tmp_path}/wide.csv", schema="a int, b int").collect()


def test_preview_and_shape(mixed):
    rows = loading.preview(mixed, order=["id"]).collect()
    assert len(rows) == 15 and rows[0]["f1"] == "" and rows[1]["id"] == "1"
    assert loading.shape(mixed) == {"rows": 100, "columns": mixed.columns, "target": "target"}
