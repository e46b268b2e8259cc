"""Exact k nearest neighbours as a Spark join, pruned with the triangle inequality.

Training vectors are grouped into cells around a bounded number of pivots; a query visits only the
cells that can hold one of its neighbours. Both sides are cut into shares of bounded bytes and each
share of queries meets each share of training vectors once, so a vector is sent as often as the
other side has shares, however many cells are visited. A cell that holds much of the table is in
several shares. Up to ``SHARES`` times ``SHARE_BYTES`` on a side the number of shares is fixed, and
what is sent grows as the tables do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.functions.small import local_frame

TRAIN_BLOCK = 4_096
QUERY_BLOCK = 512
SHARES = 8
SHARE_BYTES = 64 * 1024 * 1024  # most bytes of vectors that a task holds of either side
MAX_PIVOTS = 256
SLACK = 1e-9


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def k_nearest(query: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None):
    """``(position in train, distance)`` arrays per query row, by distance and then by id.

    The fast distances only preselect; all candidates as near as the k-th within rounding are
    measured again term by term, so copies tie exactly.
    """
    fast = squared_distances(query, train)
    if own is not None:
        fast[own[:, None] == ids[None, :]] = np.inf
    k = min(k, len(train))
    border = np.partition(fast, k - 1, axis=1)[:, k - 1]
    scale = np.abs(query).max(initial=0.0) + np.abs(train).max(initial=0.0)
    tolerance = SLACK * (1.0 + scale * scale * query.shape[1])
    for row, limit in enumerate(border):
        near = np.flatnonzero((fast[row] <= limit + tolerance) & np.isfinite(fast[row]))
        exact = np.sqrt(((train[near] - query[row]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact))[:k]
        yield near[order], exact[order]


def nearest_neighbours(
    train: DataFrame,
    query: DataFrame,
    k: int,
    train_id: str,
    query_id: str,
    vector: str,
    exclude_self: bool = False,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, distance)`` with the ``k`` nearest of each query row.

    ``vector`` is an array of numbers in both frames and the ids are unique longs. Ties go to the
    smaller id. ``exclude_self`` skips the training row with the query's own id.
    """
    points = train.select(F.col(train_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = query.select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = points.count()
    if rows == 0:
        return local_frame(
            query.sparkSession, [], f"{query_id} bigint, rank int, neighbour_id bigint, distance double"
        )
    count = min(MAX_PIVOTS, max(1, math.isqrt(rows)))
    span = 1 << 31
    chance = min(1.0, 4.0 * count / rows)
    sampled = points.where(F.pmod(F.xxhash64("id"), F.lit(span)) < F.lit(int(chance * span))).limit(count).collect()
    pivots = np.array([r["v"] for r in sampled or points.limit(1).collect()])

    @F.pandas_udf("struct<cell int, away double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = squared_distances(np.stack(batch.to_numpy()), pivots)
            cell = d.argmin(axis=1)
            away = np.sqrt(d[np.arange(len(d)), cell])
            yield pd.DataFrame({"cell": cell.astype("int32"), "away": away})

    placed = points.withColumn("_p", place("v")).select("id", "v", "_p.cell", "_p.away")
    cells = {
        r["cell"]: r
        for r in placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"))
        .collect()
    }
    used = sorted(cells)
    centres = pivots[used]
    sizes = np.array([cells[c]["n"] for c in used])
    low = np.array([cells[c]["low"] for c in used])
    high = np.array([cells[c]["high"] for c in used])
    need = k + int(exclude_self)

    # Blocks of cells are dealt to the shares of the training rows in turn, so that a crowded cell is in several.
    shares = sides(rows, len(pivots[0]))
    parts = sides(asked.count(), len(pivots[0]))
    block_count = [math.ceil(n / TRAIN_BLOCK) for n in sizes]
    first = np.cumsum([0, *block_count[:-1]])
    held = np.zeros((len(used), shares), bool)
    for j, n in enumerate(block_count):
        held[j, (first[j] + np.arange(min(n, shares))) % shares] = True

    @F.pandas_udf("struct<cells binary, shares array<int>>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = np.sqrt(squared_distances(np.stack(batch.to_numpy()), centres))
            reach = d + high
            order = np.argsort(reach, axis=1, kind="stable")
            enough = np.argmax(np.cumsum(sizes[order], axis=1) >= min(need, sizes.sum()), axis=1)
            bound = reach[np.arange(len(d)), order[np.arange(len(d)), enough]] * (1 + 1e-6) + 1e-6
            keep = (d - high <= bound[:, None]) & (low - d <= bound[:, None])
            met = keep.astype(np.int32) @ held.astype(np.int32) > 0
            yield pd.DataFrame(
                {"cells": [r.tobytes() for r in np.packbits(keep, axis=1)], "shares": [np.flatnonzero(r).astype("int32") for r in met]}
            )

    at = F.create_map(*[x for j, c in enumerate(used) for x in (F.lit(c), F.lit(j))])[F.col("cell")]
    block = F.pmod(F.xxhash64("id"), F.array(*[F.lit(n) for n in block_count])[F.col("at")])
    share = F.pmod(F.array(*[F.lit(int(f)) for f in first])[F.col("at")] + block, F.lit(shares))
    train_side = placed.withColumn("at", at).select(
        "id", "v", "at", F.explode(F.sequence(share * parts, share * parts + (parts - 1))).alias("slot")
    )
    query_side = (
        asked.select("id", "v", visits("v").alias("_m"))
        .select("id", "v", "_m.cells", F.explode("_m.shares").alias("share"))
        .select("id", "v", "cells", (F.col("share") * parts + F.pmod(F.xxhash64("id"), F.lit(parts))).alias("slot"))
    )
    slots = 2 * shares * parts
    meet = _best_of_share(k, exclude_self)
    candidates = (
        query_side.repartition(slots, "slot")
        .groupBy("slot")
        .cogroup(train_side.repartition(slots, "slot").groupBy("slot"))
        .applyInArrow(meet, "id bigint, neighbour_id bigint, distance double")
        .withColumnRenamed("id", query_id)
    )
    order = Window.partitionBy(query_id).orderBy("distance", "neighbour_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query_id, "rank", "neighbour_id", "distance")


def sides(rows: int, width: int) -> int:
    """Into how many shares one side is cut: as many as keep the cores busy, more once a share would exceed its bytes."""
    return max(1, min(SHARES, math.ceil(rows / TRAIN_BLOCK)), math.ceil(rows * (width + 2) * 8 / SHARE_BYTES))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column("v").chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _best_of_share(k: int, exclude_self: bool):
    """The ``k`` best of a share of the training rows for each of the queries that came to it.

    Only queries with a training row as near as their ``k``-th best so far are measured again term by term.
    """

    def run(asked: pa.Table, train: pa.Table) -> pa.Table:
        found = {"id": np.zeros(0, np.int64), "neighbour_id": np.zeros(0, np.int64), "distance": np.zeros(0)}
        if asked.num_rows and train.num_rows:
            q, t = _matrix(asked), _matrix(train)
            q_ids, t_ids = (x.column("id").to_numpy() for x in (asked, train))
            packed = np.frombuffer(b"".join(asked.column("cells").to_pylist()), np.uint8).reshape(len(q), -1)
            cell = train.column("at").to_numpy()
            best, near = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
            for c in np.unique(cell):
                inside = np.flatnonzero(cell == c)
                wanted = np.flatnonzero(packed[:, c >> 3] & (128 >> (c & 7)))
                for rows in (inside[i : i + TRAIN_BLOCK] for i in range(0, len(inside), TRAIN_BLOCK)):
                    some, ids = t[rows], t_ids[rows]
                    for start in range(0, len(wanted), QUERY_BLOCK):
                        _closer(q, wanted[start : start + QUERY_BLOCK], q_ids, some, ids, k, exclude_self, best, near)
            row, place = np.nonzero(np.isfinite(best))
            found = {"id": q_ids[row], "neighbour_id": near[row, place], "distance": best[row, place]}
        return pa.table(found)

    return run


def _closer(q, at, q_ids, train, ids, k: int, exclude_self: bool, best: np.ndarray, near: np.ndarray) -> None:
    """Put those of ``train`` that are nearer than the known neighbours of the queries ``at`` among them."""
    fast = squared_distances(q[at], train)
    if exclude_self:
        fast[q_ids[at][:, None] == ids[None, :]] = np.inf
    scale = np.abs(q[at]).max(initial=0.0) + np.abs(train).max(initial=0.0)
    tolerance = SLACK * (1.0 + scale * scale * q.shape[1])
    bound = best[at, -1] ** 2 + tolerance
    if len(train) > k and np.isinf(bound).any():
        bound = np.minimum(bound, np.partition(fast, k - 1, axis=1)[:, k - 1] + tolerance)
    hits = (fast <= bound[:, None]) & np.isfinite(fast)
    for i in np.flatnonzero(hits.any(axis=1)):
        row, some = at[i], np.flatnonzero(hits[i])
        exact = np.concatenate([best[row], np.sqrt(((train[some] - q[row]) ** 2).sum(axis=1))])
        both = np.concatenate([near[row], ids[some]])
        order = np.lexsort((both, exact))[:k]
        best[row], near[row] = exact[order], both[order]


def vote(neighbours: DataFrame, labels: DataFrame, query_id: str, classes: int, weights: str = "uniform") -> DataFrame:
    """``(query_id, prediction, scores)`` from neighbours and their ``(neighbour_id, label)``.

    With ``distance`` a neighbour weighs the inverse of its distance; neighbours at distance 0,
    if there are any, decide alone. The smallest class wins a tie.
    """
    known = neighbours.join(labels, "neighbour_id")
    per_class = lambda weight: F.array(
        *[F.sum(F.when(F.col("label") == c, weight).otherwise(0.0)) for c in range(classes)]
    )
    if weights == "distance":
        touching = per_class(F.when(F.col("distance") == 0, 1.0).otherwise(0.0))
        inverse = per_class(F.coalesce(F.try_divide(F.lit(1.0), "distance"), F.lit(0.0)))
        raw = F.when(F.min("distance") == 0, touching).otherwise(inverse)
    else:
        raw = per_class(F.lit(1.0))
    votes = known.groupBy(query_id).agg(raw.alias("_raw"))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, b: a + b)
    return votes.select(
        query_id,
        (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double").alias("prediction"),
        F.transform("_raw", lambda v: v / total).alias("scores"),
    )
