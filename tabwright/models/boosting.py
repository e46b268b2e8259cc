"""Second-order gradient boosting over histograms, as a pipeline stage.

Feature values become at most 255 bins, cut at quantiles that are weighted by the first round's Hessians; missing values have
a bin of their own. The binned rows are written once in blocks. For every request of a growing tree the tasks run their
blocks down the trees, work out gradients and Hessians and send one histogram a node; these are added by node and group
of features, and the driver chooses splits from the sums, whose size does not depend on the rows. Each block keeps its
margins, which are written anew every ``RENEW`` rounds; between that, tasks add the outputs of the few newer trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.small import local_frame
from tabwright.models.growing import MISSING, Grower, Rules, leaf_for, reached, sampled
from tabwright.session import remove_path, scratch_path

BINS = MISSING  # most bins of a feature, besides the one for missing values
SUMMARY = 4096  # points that stand for a feature's values in one part of the table
BLOCK_ROWS = 65_536
RENEW = 10
CHUNK = 64  # features of one message
DIRECT_TASKS = 16  # up to so many tasks, the driver adds their histograms

OBJECTIVES = ("squared", "logistic", "softmax")


# Losses


def gradients(objective: str, margin: np.ndarray, label: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients and Hessians by row and output, and the sum of losses. ``factor`` scales softmax Hessians."""
    if objective == "squared":
        apart = margin - label[:, None]
        return apart, np.ones_like(margin), float((apart**2).sum() / 2)
    if objective == "logistic":
        p = chances(objective, margin)[:, 1:]
        loss = np.logaddexp(0.0, margin[:, 0]) - label * margin[:, 0]
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16), float(loss.sum())
    p = chances(objective, margin)
    own = label.astype(int)
    top = margin.max(1)
    loss = np.log(np.exp(margin - top[:, None]).sum(1)) + top - margin[np.arange(len(own)), own]
    hit = np.zeros_like(p)
    hit[np.arange(len(own)), own] = 1.0
    return p - hit, np.maximum(factor * p * (1 - p), 1e-16), float(loss.sum())


def chances(objective: str, margin: np.ndarray) -> np.ndarray:
    """Class probabilities from margins."""
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-np.clip(margin[:, 0], -500, 500)))
        return np.stack([1 - p, p], 1)
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def starting_margin(objective: str, classes: int, labels: DataFrame) -> list[float]:
    """The best constant margins; without it, softmax starts from the log shares."""
    if objective == "squared":
        return [float(labels.agg(F.avg("label")).first()[0] or 0.0)]
    counts = {int(r["label"]): r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    shares = [min(max(counts.get(k, 0) / max(total, 1), 1e-6), 1 - 1e-6) for k in range(classes)]
    return [math.log(shares[1] / (1 - shares[1]))] if objective == "logistic" else [math.log(s) for s in shares]


# Bins


def summarised(values: np.ndarray, weights: np.ndarray, points: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Values in order with their weights, as ``points`` entries at most; each stands for the values up to itself."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, int)
    sums = np.cumsum(weights)[last] if len(values) else np.zeros(0)
    values = values[last]
    if len(values) > points:
        # The largest value is always among them, so that no value lies above all points.
        at = np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, points + 1) / points * (1 - 1e-12)))
        at = np.unique(np.append(at, len(values) - 1))
        values, sums = values[at], sums[at]
    return values, np.diff(sums, prepend=0.0)


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Largest values of all bins but the last: each value for itself if they are few, else even in weight."""
    if len(values) <= bins:
        return values[:-1]
    sums = np.cumsum(weights)
    at = np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, bins) / bins))
    return values[at[at < len(values) - 1]]


def feature_cuts(rows: DataFrame, hessian, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of every feature of ``(v array, label)``, from mergeable summaries of each part of the table."""
    schema = "feature int, part int, task int, points array<double>, weights array<double>"

    def summaries(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * size
        used, task = False, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            used = True
            x, label = _matrix(batch.column(0), size), batch.column(1).to_numpy()
            weight = hessian(label)
            for f in range(size):
                ok = ~np.isnan(x[:, f])
                held[f] = summarised(np.append(held[f][0], x[ok, f]), np.append(held[f][1], weight[ok]))
        if used:
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array(range(size), pa.int32()),
                    "part": pa.array([task % 64] * size, pa.int32()),
                    "task": pa.array([task] * size, pa.int32()),
                    "points": pa.array([v for v, _ in held], pa.list_(pa.float64())),
                    "weights": pa.array([w for _, w in held], pa.list_(pa.float64())),
                }
            )

    def merged(key, table):
        table = table.sort_by([("part", "ascending"), ("task", "ascending")])
        both = (np.concatenate([np.asarray(v, float) for v in table.column(n).to_pylist()]) for n in ("points", "weights"))
        values, weights = summarised(*both)
        if len(key) == 1:
            values, weights = cut_points(values, weights, bins), np.zeros(0)
        part = key[1].as_py() if len(key) == 2 else 0
        row = {"feature": [key[0].as_py()], "part": [part], "task": [0]}
        out = {n: pa.array(v, pa.int32()) for n, v in row.items()}
        return pa.table({**out, "points": pa.array([values], pa.list_(pa.float64())), "weights": pa.array([weights], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(summaries, schema).groupBy("feature", "part").applyInArrow(merged, schema)
    found = parts.groupBy("feature").applyInArrow(merged, schema).select("feature", "points").collect()
    by_feature = {r["feature"]: np.array(r["points"], float) for r in found}
    return [by_feature.get(f, np.zeros(0)) for f in range(size)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles; a null counts as missing."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, size)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, x[:, f], side="left")
        out[np.isnan(x[:, f]), f] = MISSING
    return out


# Blocks of binned rows

BLOCKS = "block long, bins binary, label binary, margin binary"


def _blocks(cuts: list[np.ndarray], start: list[float]):
    size = len(cuts)

    def run(batches):
        first, made, held, labels, count = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            label = np.concatenate(labels)
            margin = np.tile(np.array(start), (len(label), 1))
            return _record(first + made, np.concatenate(held), label, margin)

        for batch in batches:
            if batch.num_rows:
                held.append(binned(_matrix(batch.column(0), size), cuts))
                labels.append(batch.column(1).to_numpy())
                count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield flush()
                made, held, labels, count = made + 1, [], [], 0
        if count:
            yield flush()

    return run


def _record(block: int, bins: np.ndarray, label: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block], pa.int64()),
            "bins": pa.array([bins.tobytes()], pa.binary()),
            "label": pa.array([label.astype(np.float64).tobytes()], pa.binary()),
            "margin": pa.array([margin.tobytes()], pa.binary()),
        }
    )


@dataclass(frozen=True)
class _Round:
    """What a task needs to know: the newer rounds' trees, and how this round draws rows."""

    number: int
    size: int
    objective: str
    outputs: int
    factor: float
    newer: list[list[dict]]
    seed: int
    subsample: float
    by_gradient: bool

    def read(self, batch: pa.RecordBatch, at: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        block, *packed = (batch.column(n)[at].as_py() for n in ("block", "bins", "label", "margin"))
        bins = np.frombuffer(packed[0], np.uint8).reshape(-1, self.size)
        label = np.frombuffer(packed[1])
        margin = np.frombuffer(packed[2]).reshape(-1, self.outputs).copy()
        for trees in self.newer:
            for k, tree in enumerate(trees):
                margin[:, k] += tree["value"][reached(tree, bins)]
        return block, bins, label, margin

    def weights(self, block: int, slopes: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, self.number, block >> 32, block & 0xFFFFFFFF])
        return sampled(self.subsample, slopes, self.by_gradient, rng)


def _histograms(this: _Round, partial: list[dict], wanted: list[list[int]], features: list[np.ndarray]):
    """Each task's histograms of the wanted nodes: one row a node and group of features, and one for the loss."""

    def run(batches):
        task, loss, rows = TaskContext.get().partitionId(), 0.0, 0
        sums = {(k, n): np.zeros((len(features[k]), BINS + 1, 3)) for k, own in enumerate(wanted) for n in own}
        for batch in batches:
            for at in range(batch.num_rows):
                block, bins, label, margin = this.read(batch, at)
                g, h, own_loss = gradients(this.objective, margin, label, this.factor)
                loss, rows = loss + own_loss, rows + len(label)
                weights = this.weights(block, np.abs(g * h).sum(1))
                for k, nodes in enumerate(wanted):
                    if not nodes:
                        continue
                    ends = _nodes_on_the_way(partial[k], bins, nodes)
                    for n, on_way in ends.items():
                        use = np.flatnonzero(on_way & (weights > 0))
                        w = weights[use]
                        entries = [w * g[use, k], w * h[use, k], None]
                        for i, f in enumerate(features[k]):
                            column = bins[use, f]
                            for j, e in enumerate(entries):
                                sums[k, n][i, :, j] += np.bincount(column, e, BINS + 1)
        if rows:
            out = [(-1, 0, 0, np.array([loss, rows]).tobytes())]
            for (k, n), found in sums.items():
                out += [(k, n, c, found[c : c + CHUNK].tobytes()) for c in range(0, len(found), CHUNK)]
            names = ("output", "node", "chunk")
            columns = {name: pa.array([r[i] for r in out], pa.int32()) for i, name in enumerate(names)}
            yield pa.RecordBatch.from_pydict({**columns, "task": pa.array([task] * len(out), pa.int32()), "sums": pa.array([r[3] for r in out], pa.binary())})

    return run


def _nodes_on_the_way(tree: dict, bins: np.ndarray, nodes: list[int]) -> dict[int, np.ndarray]:
    """For each wanted node the rows that come through it. Wanted nodes have no children yet."""
    ends = reached(tree, bins)
    return {n: ends == n for n in nodes}


def _added(key, table):
    table = table.sort_by("task")
    total = None
    for packed in table.column("sums").to_pylist():
        total = np.frombuffer(packed).copy() if total is None else total + np.frombuffer(packed)
    ids = {n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("output", "node", "chunk"), key)}
    return pa.table({**ids, "task": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


SUMS = "output int, node int, chunk int, task int, sums binary"


class _Boost(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    objective = Param(Params._dummy(), "objective", "squared, logistic or softmax", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "number of rounds", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's output that is taken", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth, 0 for none", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "greatest number of leaves, 0 for none", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "added to the Hessian of a leaf", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "gain that a split must pass", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least Hessian of a leaf", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a leaf", TypeConverters.toInt)
    newton = Param(Params._dummy(), "newton", "weigh rows by Hessian in the gain", TypeConverters.toBoolean)
    subsample = Param(Params._dummy(), "subsample", "share of the rows of a round", TypeConverters.toFloat)
    byGradient = Param(Params._dummy(), "byGradient", "draw rows by the size of their gradients", TypeConverters.toBoolean)
    columnShare = Param(Params._dummy(), "columnShare", "share of the features of a tree", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature", TypeConverters.toInt)


class BoostedTrees(Estimator, _Boost, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for numbers (``squared``), two classes (``logistic``) or more (``softmax``, a tree per class and round).

    Null and NaN features go to the side of a split where they lower the loss more. Rows without a label are left out.
    """

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        probabilityCol="probability",
        objective="squared",
        classes=0,
        rounds=100,
        rate=0.3,
        maxDepth=6,
        maxLeaves=0,
        regLambda=1.0,
        minGain=0.0,
        minWeight=1.0,
        minRows=1,
        newton=True,
        subsample=1.0,
        byGradient=False,
        columnShare=1.0,
        maxBins=BINS,
        seed=42,
    ):
        super().__init__()
        self._setDefault(
            objective="squared", classes=0, rounds=100, rate=0.3, maxDepth=6, maxLeaves=0, regLambda=1.0, minGain=0.0, minWeight=1.0,
            minRows=1, newton=True, subsample=1.0, byGradient=False, columnShare=1.0, maxBins=BINS, seed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        get = self.getOrDefault
        objective, classes, spark = get("objective"), get("classes"), dataset.sparkSession
        if objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {objective!r}; use one of {', '.join(OBJECTIVES)}")
        if not 2 <= get("maxBins") <= BINS:
            raise ValueError(f"maxBins must be 2 to {BINS}")
        rows = dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("v"), F.col(self.getLabelCol()).cast("double").alias("label"))
        rows = rows.where("v IS NOT NULL AND label IS NOT NULL")
        first = rows.select(F.size("v").alias("size")).first()
        if first is None:
            raise ValueError("boosting needs rows with a label")
        outputs = max(classes, 2) if objective == "softmax" else 1
        factor = classes / (classes - 1) if objective == "softmax" and get("newton") and classes > 1 else 1.0
        start = starting_margin(objective, max(classes, 2), rows.select("label"))

        def hessian(label: np.ndarray) -> np.ndarray:
            return gradients(objective, np.tile(np.array(start), (len(label), 1)), label, factor)[1].sum(1)

        cuts = feature_cuts(rows, hessian, first["size"], get("maxBins"))
        path = scratch_path(spark, "boosting")
        rows.mapInArrow(_blocks(cuts, start), BLOCKS).write.option("compression", "zstd").parquet(path)
        rules = Rules(
            get("maxDepth"), get("maxLeaves"), get("regLambda"), get("minGain"), get("minWeight"), get("minRows"), get("newton"), get("rate"),
            (classes - 1) / classes if objective == "softmax" and not get("newton") else 1.0,
        )
        forest, newer, losses, number = [], [], [], 0
        seed, share = get("seed"), get("columnShare")
        while number < get("rounds"):
            this = _Round(number, len(cuts), objective, outputs, factor, newer, seed, get("subsample"), get("byGradient"))
            features = [_columns(len(cuts), share, [seed, number, k]) for k in range(outputs)]
            trees, loss = _one_round(spark, path, this, rules, features)
            losses.append(loss)
            forest.append(trees)
            newer = [*newer, trees]
            number += 1
            if len(newer) == RENEW and number < get("rounds"):
                path, newer = _renewed(spark, path, this, newer), []
        remove_path(spark, path)
        model = BoostedTreesModel(_with_cuts(forest, cuts), start, len(cuts), losses)
        return model._set(**{p.name: get(p) for p in self.params if self.isDefined(p)})


def _columns(size: int, share: float, seed: list[int]) -> np.ndarray:
    if share >= 1:
        return np.arange(size)
    return np.sort(np.random.default_rng(seed).permutation(size)[: max(1, math.ceil(share * size))])


def _one_round(spark: SparkSession, path: str, this: _Round, rules: Rules, features: list[np.ndarray]) -> tuple[list[dict], float]:
    """One tree for each output, grown side by side, and the mean loss before them."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    growers = [Grower(rules, own) for own in features]
    mean_loss, tasks = math.nan, blocks.rdd.getNumPartitions()
    while any(wanted := [g.wanted() for g in growers]):
        found = blocks.mapInArrow(_histograms(this, [g.partial() for g in growers], wanted, features), SUMS)
        if tasks > DIRECT_TASKS:
            found = found.groupBy("output", "node", "chunk").applyInArrow(_added, SUMS)
        rows = sorted(found.collect(), key=lambda r: (r["output"], r["node"], r["chunk"], r["task"]))
        sums: dict[tuple, np.ndarray] = {}
        for r in rows:
            key = (r["output"], r["node"], r["chunk"])
            part = np.frombuffer(r["sums"])
            sums[key] = sums[key] + part if key in sums else part
        if math.isnan(mean_loss):
            total, count = sums[-1, 0, 0]
            mean_loss = float(total / count)
        for k, grower in enumerate(growers):
            by_node = {n: [sums[k, n, c] for c in range(0, len(features[k]), CHUNK)] for n in wanted[k]}
            if by_node:
                grower.supply({n: np.concatenate(parts).reshape(len(features[k]), BINS + 1, 3) for n, parts in by_node.items()})
    return [g.tree() for g in growers], mean_loss


def _renewed(spark: SparkSession, path: str, this: _Round, newer: list[list[dict]]) -> str:
    """The blocks with the newer trees' outputs in their margins."""
    this = _Round(this.number, this.size, this.objective, this.outputs, this.factor, newer, this.seed, this.subsample, this.by_gradient)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield _record(*this.read(batch, at))

    after = scratch_path(spark, "boosting")
    spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(after)
    remove_path(spark, path)
    return after


def _with_cuts(forest: list[list[dict]], cuts: list[np.ndarray]) -> list[list[dict]]:
    """Trees with the largest value that goes left in each node; splits of missing from known values have infinity."""
    for trees in forest:
        for tree in trees:
            inner = tree["left"] >= 0
            tree["cut"] = np.full(len(inner), np.inf)
            for i in np.flatnonzero(inner):
                cut = cuts[tree["feature"][i]]
                if tree["bin"][i] < len(cut):
                    tree["cut"][i] = cut[tree["bin"][i]]
    return forest


_NODES = "round int, output int, node int, feature int, cut double, missing_left boolean, left int, right int, value double, gain double, rows double"
_KINDS = {"feature": np.int32, "cut": float, "missing_left": bool, "left": np.int32, "right": np.int32, "value": float, "gain": float, "rows": float}


class BoostedTreesModel(Model, _Boost, MLWritable, MLReadable):
    """``forest[round][output]`` are the trees as arrays over nodes; ``losses`` the mean training loss before each round."""

    def __init__(self, forest: list[list[dict]] | None = None, start: list[float] | None = None, inputs: int = 0, losses: list[float] | None = None):
        super().__init__()
        self.forest, self.start, self.inputs, self.losses = forest or [], start or [0.0], inputs, losses or []

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gains of all splits."""
        gains = np.zeros(self.inputs)
        for tree in self.trees():
            inner = tree["left"] >= 0
            np.add.at(gains, tree["feature"][inner], tree["gain"][inner])
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def trees(self) -> Iterator[dict]:
        return (tree for trees in self.forest for tree in trees)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start), (len(x), 1))
        for trees in self.forest:
            for k, tree in enumerate(trees):
                out[:, k] += tree["value"][leaf_for(tree, x)]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.forest, self.start, self.inputs))
        objective = self.getOrDefault("objective")
        scorer = BoostedTreesModel.margins

        @F.pandas_udf("array<double>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _Trees(*shared.value)
            for batch in batches:
                x = np.stack([np.asarray(v, float) for v in batch]) if len(batch) else np.zeros((0, model.inputs))
                out = scorer(model, x)
                yield pd.Series(list(out if objective == "squared" else chances(objective, out)))

        scored = dataset.withColumn("_scores", scores(vector_to_array(F.col(self.getFeaturesCol()))))
        if objective == "squared":
            return scored.withColumn(self.getPredictionCol(), F.col("_scores")[0]).drop("_scores")
        pick = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")
        scored = scored.withColumn(self.getPredictionCol(), pick)
        return scored.withColumn(self.getProbabilityCol(), array_to_vector(F.col("_scores"))).drop("_scores")

    def write(self) -> MLWriter:
        return _BoostWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostReader()


@dataclass
class _Trees:
    forest: list[list[dict]]
    start: list[float]
    inputs: int


class _BoostWriter(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = []
        for r, trees in enumerate(self.model.forest):
            for k, tree in enumerate(trees):
                for n in range(len(tree["left"])):
                    rows.append((r, k, n, *(kind(tree[name][n]).item() if kind is np.int32 else kind(tree[name][n]) for name, kind in _KINDS.items())))
        local_frame(spark, rows, _NODES).write.parquet(f"{path}/trees")
        facts = [([float(s) for s in self.model.start], self.model.inputs, [float(x) for x in self.model.losses])]
        local_frame(spark, facts, "start array<double>, inputs int, losses array<double>").write.parquet(f"{path}/facts")


class _BoostReader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        facts = spark.read.parquet(f"{path}/facts").first()
        nodes: dict[tuple[int, int], list] = {}
        for row in spark.read.parquet(f"{path}/trees").orderBy("round", "output", "node").collect():
            nodes.setdefault((row["round"], row["output"]), []).append(row)
        forest: list[list[dict]] = []
        for (number, _), rows in nodes.items():
            if number == len(forest):
                forest.append([])
            forest[number].append({name: np.array([r[name] for r in rows], kind) for name, kind in _KINDS.items()})
        model = BoostedTreesModel(forest, list(facts["start"]), facts["inputs"], list(facts["losses"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
