"""Mutual information by nearest neighbours, over sorted ranges.

For a target of classes (Ross 2014) the distance to the k-th nearest value of a row's own class is set against the number
of values of all classes within it. For a target of numbers (Kraskov, Stögbauer and Grassberger 2004) the distance to the
k-th nearest point of the plane is set against the numbers of values within it on each axis.

Equal rows are counted first. Neighbours on a line are those next in order: ranges of the order need the last and first
rows of the ranges beside them only. In the plane a range of one axis is searched outwards from each point until the gap on
the axis exceeds the k-th distance found; points whose distance reaches into other ranges are then sent there. Numbers of
values between two bounds are differences of ranks: bounds and values are put in one order and summed by range. No pairs
are made beyond the neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_double, ref
from tabwright.operators.encode import label_encode, text_columns
from tabwright.session import materialise

# Fixed value: the number of neighbours.
NEIGHBOURS = 3

RANGE_ROWS = 65_536
EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1 on, to double precision."""
    m = n + 10.0
    series = F.ln(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) + 1 / (240 * m**8) - 1 / (132 * m**10)
    return series - sum((1 / (n + float(i)) for i in range(10)), F.lit(0.0))


def range_sorted(df: DataFrame, keys: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """The frame in order of ``keys``, in partitions that are ranges of them, written so that the ranges stay."""
    parts = max(1, math.ceil(df.count() / rows))
    ordered = df.repartitionByRange(parts, *keys) if parts > 1 else df.coalesce(1)
    return materialise(ordered.sortWithinPartitions(*keys))


def _arrays(batches, names: Sequence[str]) -> dict[str, np.ndarray]:
    """The columns of a whole partition."""
    held = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    if not held:
        return {n: np.zeros(0) for n in names}
    return {n: np.concatenate([h[i] for h in held]) for i, n in enumerate(names)}


def _place(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of floating point numbers, next to each other for neighbouring ones. Its own inverse on bits."""
    bits = values.view(np.int64)
    return np.where(bits >= 0, bits, np.iinfo(np.int64).min - bits)


def reach(x: np.ndarray, distance: np.ndarray, strict: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number whose difference from ``x``, as rounded, is within ``distance``: found by bisection."""
    out = []
    for sign in (-1.0, 1.0):
        inside = _place(x + 0.0)
        outside = _place(np.where(distance > 0, x + sign * 2 * distance, np.nextafter(x, sign * np.inf)) + 0.0)
        for _ in range(66):  # more than a number has bits
            middle = (inside >> 1) + (outside >> 1) + (inside & outside & 1)
            gap = np.abs(_place(middle.view(np.float64)).view(np.float64) - x)
            within = np.where(strict, gap < distance, gap <= distance)
            between = (middle != inside) & (middle != outside)
            inside = np.where(between & within, middle, inside)
            outside = np.where(between & ~within, middle, outside)
        out.append(_place(inside.view(np.float64)).view(np.float64))
    return out[0], out[1]


# Ranks: how many values lie between two bounds


def counts_between(points: DataFrame, queries: DataFrame) -> DataFrame:
    """For each of ``queries`` (id, axis, lo, hi) the sum of ``n`` of ``points`` (axis, v, n) with lo <= v <= hi.

    Columns id, axis, inside. ``id`` identifies a query of an axis.
    """
    kinds = "axis int, v double, kind int, n long, id string"
    whole = points.selectExpr("axis", "v", "1 AS kind", "n", "CAST(NULL AS STRING) AS id")
    for bound, kind in (("lo", 0), ("hi", 2)):  # before and after values equal to the bound
        whole = whole.unionByName(queries.selectExpr("axis", f"{bound} AS v", f"{kind} AS kind", "CAST(0 AS BIGINT) AS n", "id"))
    ordered = range_sorted(whole, ["axis", "v", "kind"])

    def totals(batches):
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            axis, n = (batch.column(c).to_numpy() for c in ("axis", "n"))
            for a in np.unique(axis):
                sums[int(a)] = sums.get(int(a), 0) + int(n[axis == a].sum())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part] * len(sums), pa.int32()), "axis": pa.array(list(sums), pa.int32()), "n": pa.array(list(sums.values()), pa.int64())}
        )

    # A range holds few axes, as an axis is one run: no more rows than ranges and axes together.
    before: dict[tuple[int, int], int] = {}
    running: dict[int, int] = {}
    for part, axis, n in sorted(map(tuple, ordered.select("axis", "n").mapInArrow(totals, "part int, axis int, n long").collect())):
        before[part, axis] = running.get(axis, 0)
        running[axis] = running.get(axis, 0) + n

    def ranks(batches):
        part = TaskContext.get().partitionId()
        here: dict[int, int] = {}
        for batch in batches:
            axis, kind, n = (batch.column(c).to_numpy() for c in ("axis", "kind", "n"))
            upto = np.empty(len(axis), np.int64)
            for a in np.unique(axis):
                own = axis == a
                start = here.get(int(a), before[part, int(a)])
                upto[own] = start + np.cumsum(n[own])
                here[int(a)] = start + int(n[own].sum())
            asked = np.flatnonzero(kind != 1)
            signed = np.where(kind[asked] == 0, -upto[asked], upto[asked])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(asked)), batch.column("axis").take(pa.array(asked)), pa.array(signed)], ["id", "axis", "inside"])

    found = ordered.select(*[f.split()[0] for f in kinds.split(", ")]).mapInArrow(ranks, "id string, axis int, inside long")
    return found.groupBy("id", "axis").agg(F.sum("inside").alias("inside"))


# Neighbours of the own class on a line


def _neighbours_in_order(k: int, halo: dict[int, tuple[list, list]]):
    """Rows (f, c, x, n) in order, with up to ``k`` rows of the ranges before and after: distance and number of the nearest."""

    def run(batches):
        got = _arrays(batches, ("f", "c", "x", "n"))
        if not len(got["f"]):
            return
        front, back = halo.get(TaskContext.get().partitionId(), ([], []))
        beside = [[np.array([r[i] for r in rows], got[name].dtype) for rows in (front, back)] for i, name in enumerate(got)]
        f, c, x, n = (np.concatenate([one, own, two]) for own, (one, two) in zip(got.values(), beside, strict=True))
        own = np.arange(len(front), len(front) + len(got["f"]))
        gaps, weights = [np.zeros(len(own))], [n[own] - 1]
        for step in range(1, k + 1):
            for other in (own - step, own + step):
                there = (other >= 0) & (other < len(f))
                at = np.where(there, other, own)
                there &= (f[at] == f[own]) & (c[at] == c[own])
                gaps.append(np.where(there, np.abs(x[at] - x[own]), np.inf))
                weights.append(np.where(there, n[at], 0))
        gaps, weights = np.stack(gaps, 1), np.stack(weights, 1)
        order = np.argsort(gaps, 1, kind="stable")
        sums = np.cumsum(np.take_along_axis(weights, order, 1), 1)
        wanted = np.minimum(k, sums[:, -1])
        distance = np.take_along_axis(np.take_along_axis(gaps, order, 1), (sums >= wanted[:, None]).argmax(1)[:, None], 1)[:, 0]
        near = np.where(gaps <= distance[:, None], weights, 0).sum(1)
        keep = wanted > 0  # alone in its class
        lo, hi = reach(x[own], distance, np.zeros(len(own), bool))
        columns = {"f": f[own], "c": c[own], "x": x[own], "n": n[own], "near": near, "lo": lo, "hi": hi}
        yield pa.RecordBatch.from_pydict({name: pa.array(v[keep]) for name, v in columns.items()})

    return run


def _halos(ordered: DataFrame, k: int) -> dict[int, tuple[list, list]]:
    """Per range the last ``k`` rows before it and the first ``k`` after it; only ends of ranges come to the driver."""

    def ends(batches):
        got, part = _arrays(batches, ("f", "c", "x", "n")), TaskContext.get().partitionId()
        size = len(got["f"])
        at = sorted({*range(min(k, size)), *range(max(0, size - k), size)})
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part] * len(at), pa.int32()),
                "place": pa.array([i - size if i >= size - k else i for i in at], pa.int32()),
                "head": pa.array([i < k for i in at], pa.bool_()),
                **{name: pa.array(v[at].astype({"f": np.int32, "c": np.int64, "x": float, "n": np.int64}[name])) for name, v in got.items()},
            }
        )

    heads: dict[int, list] = {}
    tails: dict[int, list] = {}
    for r in ordered.mapInArrow(ends, "part int, place int, head boolean, f int, c long, x double, n long").collect():
        row = (r["f"], r["c"], r["x"], r["n"])
        if r["head"]:
            heads.setdefault(r["part"], []).append(row)
        if r["place"] < 0:
            tails.setdefault(r["part"], []).append(row)
    parts, out = sorted(heads), {}
    for i, part in enumerate(parts):
        front, back = [], []
        for p in reversed(parts[:i]):
            front = sorted(tails[p])[-(k - len(front)) :] + front
            if len(front) >= k:
                break
        for p in parts[i + 1 :]:
            back += sorted(heads[p])[: k - len(back)]
            if len(back) >= k:
                break
        out[part] = (front, back)
    return out


def class_information(entries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(f, mi): information between numbers ``x`` and classes ``c`` (whole numbers) of each feature ``f``, at least 0."""
    counts = entries.groupBy("f", "c", "x").agg(F.count(F.lit(1)).alias("n"))
    ordered = range_sorted(counts, ["f", "c", "x"])
    found = ordered.mapInArrow(_neighbours_in_order(k, _halos(ordered, k)), "f int, c long, x double, n long, near long, lo double, hi double")
    found = materialise(found)
    points = found.groupBy(F.col("f").alias("axis"), F.col("x").alias("v")).agg(F.sum("n").alias("n"))
    name = F.concat_ws(":", "c", "x", "n", "near").alias("id")
    inside = counts_between(points, found.select(name, F.col("f").alias("axis"), "lo", "hi"))
    rows = inside.select(
        F.col("axis").alias("f"), F.split("id", ":")[2].cast("long").alias("n"), F.split("id", ":")[3].cast("long").alias("near"), (F.col("inside") - 1).alias("within")
    )
    pairs = rows.groupBy("f").agg((F.sum(F.col("n") * (digamma(F.col("near")) - digamma(F.col("within")))) / F.sum("n")).alias("gain"))
    sizes = found.groupBy("f", "c").agg(F.sum("n").alias("n")).groupBy("f").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * digamma(F.col("n"))).alias("by_class"))
    estimate = digamma(F.col("rows")) - F.col("by_class") / F.col("rows") + F.col("gain")
    return pairs.join(sizes, "f").select("f", F.greatest(estimate, F.lit(0.0)).alias("mi"))


# Neighbours in the plane


def _insert(best: np.ndarray, rows: np.ndarray, gaps: np.ndarray, weights: np.ndarray) -> None:
    """Add distances, each as often as it weighs, to the rows' smallest ones."""
    copies = min(best.shape[1], int(weights.max(initial=0)))
    if copies:
        more = np.where(weights[:, None] > np.arange(copies), gaps[:, None], np.inf)
        best[rows] = np.sort(np.concatenate([best[rows], more], 1), 1)[:, : best.shape[1]]


def nearest_in_plane(x: np.ndarray, y: np.ndarray, n: np.ndarray, qx: np.ndarray, qy: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The smallest distances (the larger of both axes' differences) of queries to weighted points.

    ``best`` holds the ones known before, in order; points are walked outwards on the axis with more values.
    """
    if len(np.unique(y)) > len(np.unique(x)):
        x, y, qx, qy = y, x, qy, qx
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], n[order]
    best, start = best.copy(), np.searchsorted(x, qx)
    for step, first in ((1, start), (-1, start - 1)):
        live, at = np.arange(len(qx)), first.copy()
        while True:
            there = (at >= 0) & (at < len(x))
            live, at = live[there], at[there]
            along = np.abs(x[at] - qx[live])
            open_ = along <= best[live, -1]
            live, at, along = live[open_], at[open_], along[open_]
            if not len(live):
                break
            _insert(best, live, np.maximum(along, np.abs(y[at] - qy[live])), n[at])
            at = at + step
    return best


def _within_range(k: int):
    """Rows (f, x, y, n) of a range: their smallest distances to others of the range and feature."""

    def run(batches):
        got, part = _arrays(batches, ("f", "x", "y", "n")), TaskContext.get().partitionId()
        for f in np.unique(got["f"]):
            own = got["f"] == f
            x, y, n = got["x"][own], got["y"][own], got["n"][own].astype(np.int64)
            # Each point meets itself too, with all its copies: one zero too many, so one more distance is kept.
            best = nearest_in_plane(x, y, n, x, y, np.full((len(x), k + 1), np.inf))[:, 1:]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(x), pa.int32()),
                    "f": pa.array([int(f)] * len(x), pa.int32()),
                    "x": pa.array(x),
                    "y": pa.array(y),
                    "n": pa.array(n),
                    "best": pa.array(list(best), pa.list_(pa.float64())),
                }
            )

    return run


def _elsewhere(spans: dict[int, list[tuple[int, float, float]]]):
    """Rows whose distance reaches other ranges of their feature: one query each."""

    def run(batches):
        for batch in batches:
            part, f, x = (batch.column(c).to_numpy() for c in ("part", "f", "x"))
            far = np.array([b[-1] for b in batch.column("best").to_pylist()])
            rows, to = [], []
            for feature in np.unique(f):
                for other, low, high in spans[int(feature)]:
                    hit = (f == feature) & (part != other) & (low - x <= far) & (x - high <= far)
                    rows.append(np.flatnonzero(hit))
                    to.append(np.full(hit.sum(), other, np.int32))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), *[batch.column(c).take(at) for c in ("f", "x", "y", "best")]], ["part", "f", "x", "y", "best"])

    return run


def _answered(points, queries):
    """The points' distances to each query that came to their range."""
    names = ("f", "x", "y")
    out = {n: [] for n in (*names, "best")}
    if points.num_rows and queries.num_rows:
        p = {n: points.column(n).to_numpy() for n in (*names, "n")}
        q = {n: queries.column(n).to_numpy() for n in names}
        far = np.array([b[-1] for b in queries.column("best").to_pylist()])
        width = len(queries.column("best")[0])
        for f in np.unique(q["f"]):
            here, asked = p["f"] == f, np.flatnonzero(q["f"] == f)
            # Distances beyond the one known are of no use; they stay infinite.
            best = nearest_in_plane(*(p[n][here] for n in ("x", "y", "n")), q["x"][asked], q["y"][asked], np.repeat(far[asked][:, None], width, 1))
            best = np.where(best >= far[asked][:, None], np.inf, best)
            for n in names:
                out[n] += q[n][asked].tolist()
            out["best"] += best.tolist()
    return pa.table({"f": pa.array(out["f"], pa.int32()), "x": pa.array(out["x"], pa.float64()), "y": pa.array(out["y"], pa.float64()), "best": pa.array(out["best"], pa.list_(pa.float64()))})


def plane_distances(entries: DataFrame, k: int = NEIGHBOURS, rows: int = RANGE_ROWS) -> DataFrame:
    """(f, x, y, n, best): each distinct point with its count and the ``k`` smallest distances to others, infinite if fewer."""
    counts = entries.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    ordered = range_sorted(counts, ["f", "x", "y"], rows)
    schema = "part int, f int, x double, y double, n long, best array<double>"
    found = materialise(ordered.mapInArrow(_within_range(k), schema))
    spans: dict[int, list[tuple[int, float, float]]] = {}
    for r in found.groupBy("f", "part").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect():  # ranges and features
        spans.setdefault(r["f"], []).append((r["part"], r["low"], r["high"]))
    if max(map(len, spans.values()), default=0) <= 1:
        return found.drop("part")
    queries = found.mapInArrow(_elsewhere(spans), "part int, f int, x double, y double, best array<double>")
    more = found.drop("best").groupBy("part").cogroup(queries.groupBy("part")).applyInArrow(_answered, "f int, x double, y double, best array<double>")
    merged = found.select("f", "x", "y", "n", "best").unionByName(more.withColumn("n", F.lit(0).cast("long")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return merged.groupBy("f", "x", "y").agg(F.max("n").alias("n"), best.alias("best"))


def _bounds(batches):
    """Distance, number of neighbours, and the bounds of both axes; points without any other are left out."""
    for batch in batches:
        x, y, n = (batch.column(c).to_numpy() for c in ("x", "y", "n"))
        if not len(x):
            continue
        best = np.array(batch.column("best").to_pylist())
        known = np.isfinite(best).sum(1)
        keep = known > 0
        x, y, n, best, known = x[keep], y[keep], n[keep], best[keep], known[keep]
        distance = best[np.arange(len(best)), known - 1]
        near = np.where(distance == 0, n - 1, known)
        columns = {"f": batch.column("f").filter(pa.array(keep)), "x": pa.array(x), "y": pa.array(y), "n": pa.array(n), "near": pa.array(near), "zero": pa.array(distance == 0)}
        for name, v in (("x", x), ("y", y)):
            lo, hi = reach(v, distance, distance > 0)
            columns |= {f"lo_{name}": pa.array(lo), f"hi_{name}": pa.array(hi)}
        yield pa.RecordBatch.from_pydict(columns)


def plane_information(entries: DataFrame, k: int = NEIGHBOURS, rows: int = RANGE_ROWS) -> DataFrame:
    """(f, mi): information between numbers ``x`` and ``y`` of each feature ``f``, at least 0. Scales are the caller's."""
    schema = "f int, x double, y double, n long, near long, zero boolean, lo_x double, hi_x double, lo_y double, hi_y double"
    found = materialise(plane_distances(entries, k, rows).select("f", "x", "y", "n", "best").mapInArrow(_bounds, schema))
    name = F.concat_ws(":", "x", "y", "n", "near", "zero").alias("id")
    axis = {"x": F.col("f") * 2, "y": F.col("f") * 2 + 1}
    points = [found.groupBy(a.alias("axis"), F.col(c).alias("v")).agg(F.sum("n").alias("n")) for c, a in axis.items()]
    queries = [found.select(name, a.alias("axis"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c, a in axis.items()]
    inside = counts_between(points[0].unionByName(points[1]), queries[0].unionByName(queries[1]))
    part = F.split("id", ":")
    n, near, zero = part[2].cast("long"), part[3].cast("long"), part[4] == "true"
    # With a distance above zero the row itself stands for the one more of the formula.
    within = F.col("inside") - F.when(zero, 1).otherwise(0)
    terms = inside.select((F.col("axis") / 2).cast("int").alias("f"), n.alias("n"), (F.when(F.col("axis") % 2 == 0, digamma(near)).otherwise(0.0) - digamma(within)).alias("term"), (F.col("axis") % 2).alias("side"))
    sums = terms.groupBy("f").agg(F.sum(F.col("n") * F.col("term")).alias("terms"), F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("rows"))
    estimate = digamma(F.col("rows")) + F.col("terms") / F.col("rows")
    return sums.select("f", F.greatest(estimate, F.lit(0.0)).alias("mi"))


# The measure for a table


def neighbour_information(df: DataFrame, target: str, columns: Sequence[str], task: str, k: int = NEIGHBOURS) -> DataFrame:
    """``(feature, mi)`` in nats between each feature and the target, by the ``k`` nearest neighbours.

    Text is coded first. For a target of numbers both axes are scaled to unit spread. Rows without a target are left
    out; a missing feature value is information of its own: that of the gaps is added to that of the values, which weighs
    as much as their share. Equal values are neighbours at distance zero, and no noise is added. Classes of one row,
    features without spread and tables without rows have none.
    """
    columns = list(columns)
    coded = label_encode(df.where(ref(target).isNotNull()), [c for c in text_columns(df) if c in columns])
    # A sum with zero makes both zeros equal.
    values = {c: as_double(c) + F.lit(0.0) for c in columns}
    goal = as_double(target) + F.lit(0.0)
    classes = F.xxhash64(ref(target).cast("string"))
    facts = [F.count(F.lit(1)).alias("rows"), *([F.stddev_pop(goal).alias("spread")] if task == "regression" else [])]
    for i, c in enumerate(columns):
        facts += [F.count(values[c]).alias(f"n{i}"), F.stddev_pop(values[c]).alias(f"s{i}")]
    row = coded.agg(*facts).first()
    known = {i: row[f"n{i}"] for i in range(len(columns))}
    spread = {i: row[f"s{i}"] or 1.0 for i in known}
    if task == "regression":
        goal = goal / F.lit(row["spread"] or 1.0)
        values = {c: values[c] / F.lit(spread[i]) for i, c in enumerate(columns)}
    else:
        goal = classes
    stack = F.array(*[F.struct(F.lit(i).alias("f"), values[c].alias("x")) for i, c in enumerate(columns)])
    long = coded.select(goal.alias("goal"), F.inline(stack)).where("x IS NOT NULL")
    if task == "regression":
        found = plane_information(long.select("f", "x", F.col("goal").alias("y")), k)
    else:
        found = class_information(long.select("f", F.col("goal").alias("c"), "x"), k)
    seen = F.create_map(*[x for i in known for x in (F.lit(i), F.lit(known[i] / max(row["rows"], 1)))])
    parts = found.select("f", (F.col("mi") * seen[F.col("f")]).alias("mi"))
    holed = [i for i in known if 0 < known[i] < row["rows"]]
    if holed:
        gaps = F.array(*[F.struct(F.lit(i).alias("f"), values[columns[i]].isNull().cast("long").alias("gap")) for i in holed])
        marked = coded.select(goal.alias("goal"), F.inline(gaps))
        if task == "regression":
            parts = parts.unionByName(class_information(marked.select("f", F.col("gap").alias("c"), F.col("goal").alias("x")), k))
        else:
            parts = parts.unionByName(_table_information(marked))
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(i), F.lit(c))])
    none = coded.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("f"), F.lit(0.0).alias("mi"))
    return parts.unionByName(none).groupBy("f").agg(F.sum("mi").alias("mi")).select(names[F.col("f")].alias("feature"), "mi")


def _table_information(marked: DataFrame) -> DataFrame:
    """(f, mi) between gaps and classes, from their counts."""
    cells = marked.groupBy("f", "gap", "goal").agg(F.count(F.lit(1)).alias("n"))
    log_sum = lambda *by: cells.groupBy("f", *by).agg(F.sum("n").alias("n")).groupBy("f").agg(F.sum(F.col("n") * F.ln("n")).alias("s"))
    parts = [log_sum("gap", "goal"), log_sum("gap").withColumn("s", -F.col("s")), log_sum("goal").withColumn("s", -F.col("s")), log_sum()]
    whole = cells.groupBy("f").agg(F.sum("n").alias("n"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("f").agg(F.sum("s").alias("s")).join(whole, "f").select("f", F.greatest(F.col("s") / F.col("n"), F.lit(0.0)).alias("mi"))
