"""Seeded train/test splits and folds, plain and stratified.

Rows are ordered by a seeded hash of their key and cut at exact ranks. Only hash counts and the
rows next to a cut are shuffled; assigning a row to its part is a comparison with the cut values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import ref, require_columns
from tabwright.functions.ordering import ORDER, order_hash, rank_cuts
from tabwright.functions.small import broadcast_if_small, local_frame, settled

# Default share of the test part, number of folds, and the seed.
TEST_SHARE = 0.2
FOLDS = 5
SEED = 42


def _assign(df: DataFrame, key: Sequence[str], seed: int, wanted: DataFrame, rows: int, output: str) -> DataFrame:
    """Number of cuts below each row's hash, for cuts that hold for the whole table."""
    hashed = df.select(order_hash(key, seed).alias(ORDER))
    bounds = sorted(r["bound"] for r in rank_cuts(hashed, wanted, rows=rows).collect())
    place = sum(((order_hash(key, seed) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    return df.withColumn(output, place)


def _assign_within(
    df: DataFrame, stratum: str, key: Sequence[str], seed: int, wanted: DataFrame, rows: int, output: str
) -> DataFrame:
    """The same with cuts of their own for each value of ``stratum``."""
    hashed = df.select(ref(stratum).alias("_stratum"), order_hash(key, seed).alias(ORDER))
    cuts = rank_cuts(hashed, wanted.where("rank > 0"), ["_stratum"], rows)
    # A cut at rank 0 lies below every row of its stratum.
    open_cuts = wanted.where("rank = 0").select("_stratum", "cut", F.lit("").alias("bound"))
    bounds = cuts.unionByName(open_cuts).groupBy("_stratum").agg(F.collect_list("bound").alias("_bounds"))
    joined = df.join(broadcast_if_small(bounds), ref(stratum).eqNullSafe(F.col("_stratum")), "left")
    own = order_hash(key, seed)
    place = F.size(F.filter(F.col("_bounds"), lambda b: own > b))
    return joined.select(*[ref(c) for c in df.columns], place.alias(output))


def _class_counts(df: DataFrame, stratum: str) -> DataFrame:
    return settled(df.groupBy(ref(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("n")))


def holdout_split(
    df: DataFrame, key: Sequence[str], share: float = TEST_SHARE, seed: int = SEED, output: str = "is_test"
) -> DataFrame:
    """Mark exactly ``ceil(share * rows)`` rows as test."""
    require_columns(df, *key)
    rows = df.count()
    wanted = local_frame(df.sparkSession, [(0, math.ceil(share * rows))], "cut int, rank bigint")
    return _assign(df, key, seed, wanted, rows, output).withColumn(output, F.col(output) == 0)


def stratified_split(
    df: DataFrame,
    stratum: str,
    key: Sequence[str],
    share: float = TEST_SHARE,
    seed: int = SEED,
    output: str = "is_test",
) -> DataFrame:
    """Mark the same total as test, spread over the classes in proportion.

    Each class gives the floor of its share; the rest goes to the largest remainders, the first
    class in sort order on a tie. A class of one row stays in train.
    """
    require_columns(df, stratum, *key)
    counts = _class_counts(df, stratum)
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    test_rows = math.ceil(share * rows)
    exact = F.when(F.col("n") > 1, F.col("n") * F.lit(float(test_rows)) / F.lit(float(max(rows, 1)))).otherwise(0.0)
    quotas = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    given = quotas.agg(F.coalesce(F.sum("_floor"), F.lit(0))).first()[0]
    by_rest = Window.orderBy(
        F.desc(F.col("n") > 1), F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.col("_stratum")
    )
    extra = ((F.row_number().over(by_rest) <= test_rows - given) & (F.col("n") > 1)).cast("bigint")
    wanted = quotas.select("_stratum", F.lit(0).alias("cut"), (F.col("_floor") + extra).alias("rank"))
    marked = _assign_within(df, stratum, key, seed, wanted, rows, output)
    return marked.withColumn(output, F.col(output) == 0)


def kfold(
    df: DataFrame, key: Sequence[str], folds: int = FOLDS, seed: int = SEED, output: str = "fold"
) -> DataFrame:
    """Number each row's fold from 0; sizes differ by one at most, the first folds being larger."""
    require_columns(df, *key)
    rows = df.count()
    ends, upto = [], 0
    for i in range(folds - 1):
        upto += rows // folds + (i < rows % folds)
        ends.append((i, upto))
    wanted = local_frame(df.sparkSession, ends, "cut int, rank bigint")
    return _assign(df, key, seed, wanted, rows, output)


def stratified_kfold(
    df: DataFrame,
    stratum: str,
    key: Sequence[str],
    folds: int = FOLDS,
    seed: int = SEED,
    output: str = "fold",
) -> DataFrame:
    """Folds that hold each class in proportion and differ by one row at most in total.

    The rows are thought of as sorted by class and dealt to the folds in turn, which gives the
    number of rows of each class per fold; which rows those are follows the hash order.
    """
    require_columns(df, stratum, *key)
    counts = _class_counts(df, stratum)
    upto = Window.orderBy("_stratum").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def dealt(position: Column, fold: Column) -> Column:
        """How many of the first ``position`` rows are dealt to ``fold``."""
        return F.floor((position - fold + (folds - 1)) / folds)

    cuts = placed.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(folds - 2))))
    rank = F.aggregate(
        F.sequence(F.lit(0), F.col("cut")),
        F.lit(0).cast("bigint"),
        lambda total, fold: total + dealt(F.col("end"), fold) - dealt(F.col("start"), fold),
    )
    wanted = cuts.select("_stratum", "cut", rank.alias("rank"))
    return _assign_within(df, stratum, key, seed, wanted, rows, output)
