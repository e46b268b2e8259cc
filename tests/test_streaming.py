"""Scores of a stream against scores of the whole table, over restarts and failures."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabwright.models.boosting import BoostedTrees
from tabwright.operators import prep
from tabwright.streaming.score import score_new_files, score_stream


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 13), ["a", "b", None][i % 3], float((i % 13 > 6) + (i % 3 == 0))) for i in range(300)]
    return spark.createDataFrame(rows, "id long, x double, w string, label double")


def files(df, path, parts, mode="append"):
    df.repartition(parts, "id").write.mode(mode).parquet(path)


def test_stream_equals_batch_and_restarts_repeat_nothing(spark, table, tmp_path):
    stages = prep.fit_preprocessing(table, ["x"], ["w"])
    fitted = PipelineModel([*stages.stages, BoostedTrees(rounds=3).fit(stages.transform(table))])
    fitted.write().overwrite().save(f"{tmp_path}/model")
    saved = PipelineModel.load(f"{tmp_path}/model")
    first, rest = table.where("id < 200"), table.where("id >= 200")
    files(first, f"{tmp_path}/in", 4)
    call = lambda n=2: score_new_files(spark, f"{tmp_path}/in", table.schema, saved, f"{tmp_path}/out", f"{tmp_path}/check", ["id", "prediction"], files_at_once=n)
    expected = {r["id"]: r["prediction"] for r in fitted.transform(table).collect()}
    got = lambda df: sorted((r["id"], r["prediction"]) for r in df.collect())
    assert got(call()) == sorted((i, p) for i, p in expected.items() if i < 200)
    assert got(call()) == sorted((i, p) for i, p in expected.items() if i < 200)  # nothing new
    files(rest, f"{tmp_path}/in", 3)
    assert got(call(1)) == sorted(expected.items())
    assert len({f for f in (r[0] for r in spark.read.parquet(f"{tmp_path}/out").select(F.input_file_name()).collect())}) >= 2


def test_a_failed_batch_is_taken_up_again(spark, table, tmp_path):
    plain = Pipeline(stages=[VectorAssembler(inputCols=["label"], outputCol="features"), BoostedTrees(rounds=1)]).fit(table)
    files(table.where("id < 150"), f"{tmp_path}/in", 3)

    @F.udf("double")
    def broken(v):
        raise RuntimeError("lost")

    class Failing:
        def transform(self, rows):
            return plain.transform(rows).withColumn("prediction", broken("prediction"))

    call = lambda p: score_new_files(spark, f"{tmp_path}/in", table.schema, p, f"{tmp_path}/out", f"{tmp_path}/check", ["id", "prediction"], files_at_once=1)
    with pytest.raises(Exception, match="lost"):
        call(Failing())
    out = call(plain)
    assert out.count() == out.select("id").distinct().count() == 150


def test_plain_frames_are_refused(table):
    with pytest.raises(ValueError, match="must be a stream"):
        score_stream(table, PipelineModel([]), "x", "y", ["id"])
