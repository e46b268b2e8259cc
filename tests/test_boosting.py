"""Boosted trees against a plain search for splits, and what is promised of them."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.models import boosting
from tabwright.models.boosting import BoostedTrees, binned, cut_points, feature_cuts, gradients, summarised
from tabwright.models.build import TrainFacts, build_model
from tabwright.models.growing import MISSING, Grower, Rules, best_split, sampled
from tabwright.operators.tree_shap import boosted_tables, shapley_rows, tree_shap


def frame(spark, x, y, parts=3):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names) + ", label double")
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df.repartition(parts, "id")).cache()


def table(count=400, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=count), rng.integers(0, 4, count), np.round(rng.normal(size=count), 1), rng.random(count)], 1)
    y = np.where(x[:, 0] > 0.3, 2.0, 0) * (x[:, 1] != 2) + x[:, 2] ** 2 + 0.1 * rng.normal(size=count)
    if gaps:
        hole = rng.random(count) < 0.25
        x[hole, 0] = np.nan
        y[hole] += 1.5
    return x, y


def plain_split(x, g, h, rules):
    """The best split over all features, values and sides of missing values, by trying each."""

    def quality(rows):
        weight = (h[rows].sum() if rules.newton else len(rows)) + rules.reg_lambda
        return g[rows].sum() ** 2 / weight / 2 if weight > 0 else 0.0

    every, best = np.arange(len(x)), None
    for f in range(x.shape[1]):
        for cut in np.unique(x[~np.isnan(x[:, f]), f]):
            for to_left in (True, False):
                left = np.where(np.isnan(x[:, f]), to_left, x[:, f] <= cut)
                one, two = every[left], every[~left]
                if min(len(one), len(two)) < max(1, rules.min_rows) or min(h[one].sum(), h[two].sum()) < rules.min_weight:
                    continue
                gain = quality(one) + quality(two) - quality(every) - rules.min_gain
                if gain > 1e-10 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, cut, one, two)
    return best


def plain_tree(x, g, h, rules):
    """Leaves as sets of rows with their values, grown best first, and the gains in order of splitting."""
    order = itertools.count()

    def entry(rows, depth):
        found = plain_split(x[rows], g[rows], h[rows], rules) if not rules.max_depth or depth < rules.max_depth else None
        return (-found[0] if found else 0.0, next(order), rows, depth, found)

    heap, leaves, gains = [entry(np.arange(len(x)), 0)], [], []
    while heap:
        minus, _, rows, depth, found = heapq.heappop(heap)
        if found is None or rules.max_leaves and len(heap) + len(leaves) + 2 > rules.max_leaves:
            leaves.append(rows)
            continue
        gains.append(-minus)
        for part in found[3:]:
            heapq.heappush(heap, entry(rows[part], depth + 1))
    return {tuple(rows): -rules.rate * rules.leaf_scale * g[rows].sum() / (h[rows].sum() + rules.reg_lambda) for rows in leaves}, gains


RULES = [
    Rules(max_depth=3),
    Rules(max_depth=4, reg_lambda=0.0, min_rows=15, min_weight=0.0, newton=False, rate=0.1),
    Rules(max_depth=0, max_leaves=9, reg_lambda=0.5, min_gain=0.2, min_rows=10),
    Rules(max_depth=3, max_leaves=5),
]


@pytest.mark.parametrize("rules", RULES)
@pytest.mark.parametrize("objective", ["squared", "logistic"])
def test_one_tree_equals_a_plain_search(spark, rules, objective):
    """Depth, leaves in the order of their gains, regularisation, and the side of missing values."""
    x, y = table()
    label = y if objective == "squared" else (y > 1).astype(float)
    df = frame(spark, x, label)
    fitted = BoostedTrees(
        objective=objective, classes=2, rounds=1, rate=rules.rate, maxDepth=rules.max_depth, maxLeaves=rules.max_leaves, regLambda=rules.reg_lambda,
        minGain=rules.min_gain, minWeight=rules.min_weight, minRows=rules.min_rows, newton=rules.newton, maxBins=255,
    ).fit(df)
    values = np.zeros(x.shape)  # what the model sees: the largest value of each bin
    for f in range(x.shape[1]):
        cuts = np.append(feature_cuts(df.select(vector_to_array("features").alias("v"), "label"), lambda y: np.ones(len(y)), 4)[f], np.inf)
        code = np.searchsorted(cuts, x[:, f])
        values[:, f] = np.where(np.isnan(x[:, f]), np.nan, code)
    margin = np.full((len(x), 1), fitted.start[0])
    g, h, _ = gradients(objective, margin, label, 1.0)
    leaves, gains = plain_tree(values, g[:, 0], h[:, 0], rules)
    found = {}
    (tree,) = fitted.forest[0]
    for i, end in enumerate(fitted.margins(x)[:, 0] - fitted.start[0]):
        found.setdefault(round(end, 9), []).append(i)
    expected = {}
    for rows, value in leaves.items():
        expected.setdefault(round(value, 9), []).extend(rows)
    assert {v: sorted(r) for v, r in expected.items()} == found
    np.testing.assert_allclose(np.sort(tree["gain"][tree["left"] >= 0]), np.sort(gains), rtol=1e-9)
    if rules.max_leaves:
        # A limit, not a depth; with two kinds of labels gains may run out before.
        assert (tree["left"] < 0).sum() == len(leaves) <= rules.max_leaves and (objective == "logistic" or len(leaves) == rules.max_leaves)
    assert tree["rows"][0] == len(x)


def test_subtraction_and_direct_histograms_agree(monkeypatch):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 30, (3000, 5)).astype(np.uint8)
    bins[rng.random(3000) < 0.2, 1] = MISSING
    g, h = rng.normal(size=3000) + (bins[:, 0] > 12), rng.random(3000) + 0.5

    def grown(held):
        monkeypatch.setattr("tabwright.models.growing.HELD_BYTES", held)
        grower, asked = Grower(Rules(max_depth=0, max_leaves=17), np.arange(5)), 0
        while wanted := grower.wanted():
            asked += len(wanted)
            from tabwright.models.growing import reached

            ends = reached(grower.partial(), bins)
            out = {}
            for n in wanted:
                use = ends == n
                out[n] = np.stack([np.stack([np.bincount(bins[use, f], w, 256) for w in (g[use], h[use], None)], 1) for f in range(5)]).astype(float)
            grower.supply(out)
        return grower.tree(), asked

    (one, few), (two, many) = grown(1 << 30), grown(0)
    assert few < many
    for name in one:
        np.testing.assert_allclose(one[name], two[name], rtol=1e-8, atol=1e-10)


def test_ties_go_to_the_first_feature_and_bin():
    histogram = np.zeros((2, 6, 3))
    histogram[:, 0], histogram[:, 2] = [-3.0, 2, 2], [3.0, 2, 2]
    found = best_split(histogram, Rules())
    assert (found.feature, found.bin, found.missing_left) == (0, 0, True)
    assert best_split(np.zeros((2, 6, 3)), Rules()) is None


def test_bins_are_even_in_weight_and_merge():
    rng = np.random.default_rng(9)
    values, weights = np.round(rng.normal(size=60_000), 4), rng.random(60_000) + np.linspace(0, 3, 60_000)
    parts = [summarised(values[n::7], weights[n::7]) for n in range(7)]
    merged = summarised(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    assert len(merged[0]) <= boosting.SUMMARY and merged[1].sum() == pytest.approx(weights.sum())
    shares = np.bincount(np.searchsorted(cut_points(*merged, 64), values), weights) / weights.sum()
    assert len(shares) == 64 and shares.max() < 1.1 / 64 and shares.min() > 0.9 / 64
    few = summarised(np.array([3.0, 1, 3, 2]), np.ones(4))
    assert few[0].tolist() == [1, 2, 3] and few[1].tolist() == [1, 1, 2] and cut_points(*few).tolist() == [1, 2]
    assert binned(np.array([[0.5], [1], [1.5], [9], [np.nan]]), [np.array([1.0, 2])])[:, 0].tolist() == [0, 0, 1, 2, MISSING]


def test_weighted_bins_follow_the_hessian(spark):
    x, y = table(3000, gaps=False)
    df = frame(spark, x, (y > 3).astype(float)).select(vector_to_array("features").alias("v"), "label")
    even, heavy = (feature_cuts(df, w, 4, 8)[0] for w in (lambda y: np.ones(len(y)), lambda y: 1 + 9 * y))
    assert len(even) == len(heavy) == 7
    weight = 1 + 9 * (y > 3)
    shares = np.bincount(np.searchsorted(heavy, x[:, 0]), weight) / weight.sum()
    assert abs(shares - 1 / 8).max() < 0.01 < abs(np.bincount(np.searchsorted(even, x[:, 0]), weight) / weight.sum() - 1 / 8).max()


def test_rows_drawn_by_gradient_keep_the_sum():
    rng = np.random.default_rng(0)
    size = rng.random(10_000) ** 4
    weights = sampled(1.0, size, True, np.random.default_rng(1))
    assert (weights > 0).sum() == 3000 and (weights[np.argsort(-size)[:2000]] == 1).all()
    assert abs((weights * size).sum() / size.sum() - 1) < 0.03
    assert abs(sampled(0.3, size, False, rng).mean() - 0.3) < 0.02


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 300)
    x = np.array([[0.0, 0.0, 1.0], [2.0, 0.0, -1.0], [0.0, 2.0, 0.0]])[y] + rng.normal(size=(300, 3))
    x[rng.random(300) < 0.2, 1] = np.nan
    return frame(spark, x, y)


@pytest.mark.parametrize("name", ["GradientBoostingClassifier", "XGBClassifier", "LGBMClassifier"])
def test_several_classes_are_learned_jointly(classes, name):
    fitted = build_model(name, "classification", {"n_estimators": 12}, TrainFacts(300, 3)).fit(classes)
    assert [len(trees) for trees in fitted.forest] == [3] * 12
    assert all(b < a for a, b in zip(fitted.losses, fitted.losses[1:]))  # also across renewed margins
    scored = fitted.transform(classes).select("label", "prediction", vector_to_array("probability").alias("p"))
    rows = scored.collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-12 and r["prediction"] == np.argmax(r["p"]) for r in rows)
    x = np.array([r["v"] for r in classes.select(vector_to_array("features").alias("v")).collect()])
    y = np.array([r["label"] for r in classes.collect()])
    final = gradients("softmax", fitted.margins(x), y, 1.0)[2] / len(y)
    assert final < fitted.losses[-1]


@pytest.mark.parametrize("options", [{"subsample": 0.5, "columnShare": 0.7}, {"byGradient": True, "maxLeaves": 8, "maxDepth": 0}])
def test_sampling_is_repeatable_and_learns(spark, options):
    x, y = table()
    df = frame(spark, x, y)
    one, two = (BoostedTrees(rounds=14, minRows=3, **options).fit(df) for _ in range(2))
    assert (one.margins(x) == two.margins(x)).all() and one.losses[-1] < 0.3 * one.losses[0]
    other = BoostedTrees(rounds=14, minRows=3, seed=7, **options).fit(df)
    assert (one.margins(x) != other.margins(x)).any()
    if options.get("columnShare"):
        assert all(len({*tree["feature"][tree["left"] >= 0]}) <= 3 for tree in one.trees())


@pytest.mark.parametrize("name", ["XGBRegressor", "LGBMClassifier"])
def test_saved_models_score_alike(spark, classes, tmp_path, name):
    task = "regression" if name.endswith("Regressor") else "classification"
    fitted = build_model(name, task, {"n_estimators": 3}, TrainFacts(300, 3)).fit(classes)
    PipelineModel([fitted]).write().overwrite().save(str(tmp_path))
    again = PipelineModel.load(str(tmp_path))
    before, after = ({r["id"]: r["prediction"] for r in m.transform(classes).collect()} for m in (fitted, again))
    assert before == after and again.stages[0].losses == fitted.losses
    assert again.stages[0].featureImportances == fitted.featureImportances and abs(fitted.featureImportances.toArray().sum() - 1) < 1e-12


@pytest.mark.parametrize("name", ["XGBRegressor", "XGBClassifier"])
def test_shapley_values_follow_the_definition(spark, classes, name):
    task = "regression" if name.endswith("Regressor") else "classification"
    fitted = build_model(name, task, {"n_estimators": 3, "max_depth": 3}, TrainFacts(300, 3)).fit(classes)
    tables, outputs, base, missing = boosted_tables(fitted)
    x = np.array([r["v"] for r in classes.select(vector_to_array("features").alias("v")).limit(30).collect()])
    assert np.isnan(x).any()
    phi = shapley_rows(x, tables, outputs, missing)
    np.testing.assert_allclose(phi.sum(1) + base, fitted.margins(x), atol=1e-9)

    def value(tree, row, known, node=0):
        if tree["left"][node] < 0:
            return tree["value"][node]
        f, kids = tree["feature"][node], (tree["left"][node], tree["right"][node])
        if f in known:
            left = tree["missing_left"][node] if np.isnan(row[f]) else row[f] <= tree["cut"][node]
            return value(tree, row, known, kids[0] if left else kids[1])
        return sum(value(tree, row, known, k) * tree["rows"][k] / tree["rows"][node] for k in kids)

    for row, found in zip(x[:6], phi[:6]):
        for j in range(3):
            rest = [f for f in range(3) if f != j]
            for k in range(outputs):
                total = lambda known: sum(value(trees[k], row, known) for trees in fitted.forest)
                parts = [(total({*s, j}) - total(set(s))) * (1 / 3 if len(s) in (0, 2) else 1 / 6) for n in range(3) for s in itertools.combinations(rest, n)]
                assert found[j, k] == pytest.approx(sum(parts), abs=1e-9)
    explained = tree_shap(classes, fitted).select("shap").first()["shap"]
    assert len(explained) == 3 and len(explained[0]) == outputs


def test_partial_histograms_add_up_over_tasks(spark, monkeypatch):
    x, y = table(200)
    one = BoostedTrees(rounds=2).fit(frame(spark, x, y, 1))
    monkeypatch.setattr(boosting, "DIRECT_TASKS", 1)
    monkeypatch.setattr(boosting, "CHUNK", 3)
    many = BoostedTrees(rounds=2).fit(frame(spark, x, y, 6))
    np.testing.assert_allclose(one.margins(x), many.margins(x), atol=1e-9)


def test_odd_tables(spark):
    same = frame(spark, np.ones((20, 2)), np.arange(20.0))
    fitted = BoostedTrees(rounds=2).fit(same)
    assert fitted.margins(np.array([[1.0, np.nan]]))[0, 0] == pytest.approx(9.5) and not fitted.featureImportances.toArray().any()
    nothing = frame(spark, np.full((20, 1), np.nan), np.arange(20.0))
    assert BoostedTrees(rounds=1).fit(nothing).margins(np.array([[3.0]]))[0, 0] == pytest.approx(9.5)
    one_kind = BoostedTrees(objective="logistic", classes=2, rounds=1).fit(frame(spark, np.arange(10.0)[:, None], np.zeros(10)))
    assert one_kind.transform(same.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rows with a label"):
        BoostedTrees().fit(same.where("label < 0"))
    with pytest.raises(ValueError, match="unknown objective"):
        BoostedTrees(objective="poisson").fit(same)
    assert same.where(F.col("label").isNull()).count() == 0
