"""Seeded row order by hash, exact rank cuts on it, running totals and codes without a global window."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import ref
from tabwright.functions.small import broadcast_if_small
from tabwright.session import materialise

ORDER = "_order"
CELL_ROWS = 50_000
ONE_TASK_ROWS = 1_000_000


def order_hash(key: Sequence[str], seed: int) -> Column:
    """Pseudo-random but repeatable position of a row: MD5 over the seed and the row key.

    The key must identify the row; rows that share a key share a position.
    """
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[ref(c).cast("string") for c in key]))


def rank_cuts(hashed: DataFrame, wanted: DataFrame, strata: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Hash value at each wanted 1-based rank of the hash order, per stratum.

    ``hashed`` holds the strata and ``ORDER``; ``wanted`` holds the strata, ``cut`` and ``rank``.
    Rows are counted by hash prefix, so only rows of the prefixes that hold a wanted rank get
    sorted. The table itself is never shuffled.
    """
    strata = list(strata)
    rows = hashed.count() if rows is None else rows
    digits = min(max(math.ceil(math.log(max(rows / CELL_ROWS, 1), 16)), 1), 5)
    prefix = F.substring(ORDER, 1, digits)
    cells = hashed.groupBy(*strata, prefix.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*strata).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("last", F.sum("n").over(upto))
    listed = wanted.groupBy(*strata).agg(F.collect_list(F.struct("cut", F.col("rank").cast("bigint").alias("rank"))).alias("_wanted"))
    if strata:
        listed = listed.withColumnsRenamed({name: f"_w_{name}" for name in strata})
        same = reduce(and_, [ref(name).eqNullSafe(ref(f"_w_{name}")) for name in strata])
        cells = cells.join(broadcast_if_small(listed), same)
    else:
        cells = cells.withColumn("_wanted", F.array(*[F.struct(F.lit(w["cut"]).alias("cut"), F.lit(w["rank"]).alias("rank")) for w in listed.first()["_wanted"]]))
    before = F.col("last") - F.col("n")
    held = F.filter("_wanted", lambda w: (w["rank"] > before) & (w["rank"] <= F.col("last")))
    hits = cells.select(
        *[ref(name).alias(f"_{name}") for name in strata], "cell", before.alias("_before"), F.inline(held)
    ).withColumn("rank", F.col("rank") - F.col("_before")).drop("_before")
    hits = broadcast_if_small(hits)
    same_cell = F.col("cell") == prefix
    for name in strata:
        same_cell = same_cell & ref(f"_{name}").eqNullSafe(ref(name))
    border = hashed.join(hits, same_cell)
    in_cut = Window.partitionBy(*[f"_{name}" for name in strata], "cut").orderBy(ORDER)
    return (
        border.withColumn("_at", F.row_number().over(in_cut))
        .where(F.col("_at") == F.col("rank"))
        .select(*[ref(name) for name in strata], "cut", F.col(ORDER).alias("bound"))
    )


def running_totals(
    df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Sum of each value column over the rows that come strictly before, as ``before_<value>``.

    ``order`` must be a double that is unique within ``by``. Above ``ONE_TASK_ROWS`` rows the order
    is cut into ranges by approximate quantiles; ranges are totalled first and each range then runs
    its own window, so no task sees more than one range.
    """
    by = list(by)
    rows = df.count() if rows is None else rows
    ranges = min(max(math.ceil(rows / ONE_TASK_ROWS), 1), 5_000)
    inner = []
    if ranges > 1:
        probs = [i / ranges for i in range(1, ranges)]
        inner = sorted(set(df.agg(F.percentile_approx(ref(order), probs, 10_000).alias("p")).first()["p"]))
    if inner:
        splits = [-math.inf, *inner, math.inf]
        binned = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)
    else:
        binned = df.withColumn("_range", F.lit(0.0))
    totals = binned.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values]
    )
    inner_rows = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = binned.select(
        "*", *[F.coalesce(F.sum(v).over(inner_rows), F.lit(0)).alias(f"_in_{v}") for v in values]
    )
    if inner:
        joined = inside.join(broadcast_if_small(offsets), [*by, "_range"])
    else:
        joined = inside.select("*", *[F.lit(0).alias(f"_off_{v}") for v in values])
    return joined.select(
        *[ref(c) for c in df.columns],
        *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values],
    )


def sorted_positions(distinct_rows: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``position``: 0-based place of each row in the sort by ``order``."""
    rows = distinct_rows.count() if rows is None else rows
    keys = [ref(c) for c in order]
    if rows <= ONE_TASK_ROWS:
        whole = Window.orderBy(*keys)
        return distinct_rows.withColumn("position", F.row_number().over(whole) - 1)
    # The id holds the partition in its upper bits and the row's place in it in the lower 33.
    placed = materialise(distinct_rows.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(start)]
        start += sizes[p]
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("position", F.create_map(*offsets)[part] + within).drop("_id")
