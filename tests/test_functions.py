import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import ordering, quantiles
from tabwright.functions.counting import top_values, value_counts
from tabwright.functions.quantiles import exact_medians, exact_quantiles
from tabwright.functions.small import TASK_ROWS, spread
from tabwright.operators import select

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of one column is a single value; the other has a long tail and gaps."""
    rng = np.random.default_rng(3)
    rows = [
        (7.0 if i % 3 == 0 else float(rng.integers(0, 50)), None if i % 4 == 0 else float(np.exp(rng.normal() * 4)), None)
        for i in range(20_000)
    ]
    return spark.createDataFrame(rows, "hot double, tail double, empty double").repartition(6).cache()


@pytest.mark.parametrize("bracket_rows", [10_000_000, 500, 10])
def test_quantiles_match_numpy_on_both_paths(skewed, bracket_rows):
    found = exact_quantiles(skewed, ["hot", "tail", "empty"], PROBS, bracket_rows=bracket_rows)
    table = skewed.toPandas()
    for c in ("hot", "tail"):
        np.testing.assert_allclose(found[c], np.quantile(table[c].dropna(), PROBS), rtol=1e-12)
    assert found["empty"] == [None] * len(PROBS)


def test_median_of_one_and_two_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 8.0)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": 1.0, "b": 6.5}


def test_top_value_prefers_the_smaller_on_a_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    row = top_values(value_counts(df, ["v"])).first()
    assert (row["top"], row["freq"], row["levels"], row["total"]) == ("a", 2, 2, 4)


@pytest.mark.parametrize("one_task_rows", [1_000_000, 50])
def test_running_totals_do_not_depend_on_the_ranges(spark, monkeypatch, one_task_rows):
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", one_task_rows)
    df = spark.range(1000).select((F.col("id") * 1.5).alias("o"), (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    rows = ordering.running_totals(df, "o", ["v"], ["g"]).toPandas().sort_values("o")
    for _, part in rows.groupby("g"):
        assert (part["before_v"].to_numpy() == np.concatenate([[0], part["v"].cumsum().to_numpy()[:-1]])).all()


@pytest.mark.parametrize("one_task_rows", [1_000_000, 10])
def test_sorted_positions(spark, monkeypatch, one_task_rows):
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", one_task_rows)
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = ordering.sorted_positions(df, ["k"]).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["k"] for r in rows)
    assert sorted(r["position"] for r in rows) == list(range(500))


def test_rank_cuts_with_few_rows_per_cell(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CELL_ROWS", 3)
    hashed = spark.range(2000).select(ordering.order_hash(["id"], 42).alias(ordering.ORDER))
    wanted = spark.createDataFrame([(0, 1), (1, 777), (2, 2000)], "cut int, rank bigint")
    cuts = {r["cut"]: r["bound"] for r in ordering.rank_cuts(hashed, wanted).collect()}
    ordered = sorted(r[0] for r in hashed.collect())
    assert cuts == {0: ordered[0], 1: ordered[776], 2: ordered[1999]}


def test_spread_bounds_the_rows_of_a_task(spark):
    one = spark.range(1_000).coalesce(1)
    parts = spread(one, 300).rdd.glom().map(len).collect()
    assert sum(parts) == 1_000 and max(parts) <= 300
    assert spread(one, 1_000).rdd.getNumPartitions() == 1


def test_elimination_spreads_the_rows_of_its_forest(spark, monkeypatch):
    seen = []

    def kept(df):
        seen.append(df.rdd.getNumPartitions())
        return df.limit(100)

    monkeypatch.setattr(select, "materialise", kept)
    rows = spark.range(2 * TASK_ROWS).coalesce(1).select("id", (F.col("id") % 7).alias("b"), (F.col("id") % 3).alias("y"))
    assert len(select.forest_elimination(rows, "y", ["id", "b"], 1, "regression")) == 1
    assert seen == [2]


def test_ranking_lays_out_no_rows_outside_the_brackets(spark, monkeypatch):
    """A column of few values has brackets of one value, which need no counting; of others only the rows inside are laid out."""
    laid = []
    inline = F.inline

    def seen(column):
        laid.append(column)
        return inline(column)

    monkeypatch.setattr(quantiles.F, "inline", seen)
    rows = spark.range(40_000).selectExpr("CAST(id % 3 AS DOUBLE) AS few", "CAST(id AS DOUBLE) AS many")
    probs = [0.1, 0.5, 0.9]
    assert exact_quantiles(rows, ["few"], probs, bracket_rows=100) == {"few": [0.0, 1.0, 2.0]}
    assert not laid
    brackets = []
    counted = quantiles._counted_values

    def kept(df, slots, spans):
        brackets.extend(spans.values())
        return counted(df, slots, spans)

    monkeypatch.setattr(quantiles, "_counted_values", kept)
    assert exact_quantiles(rows, ["many"], probs, bracket_rows=100)["many"] == pytest.approx([p * 39_999 for p in probs])
    assert len(laid) == 1 and sum(b.inside for b in brackets) < 400
