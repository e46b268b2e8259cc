"""The parameter search against a plain version, and its rules for ending trials."""

import math
import random

import numpy as np
import pytest

from tabwright.models.catalog import Range
from tabwright.operators import prep
from tabwright.operators.split import kfold
from tabwright.plans import tune as tuning
from tabwright.plans.run import run
from tabwright.plans.search import CANDIDATES, COMPLETE, FAILED, PRUNED, STOPPED, Density, Sampler, Trial, below_median, search
from tabwright.plans.tune import fold_frames, tune
from tabwright.sources.store import Store

SPACE = {
    "rate": Range("log", 0.01, 1.0),
    "share": Range("real", -2.0, 3.0),
    "depth": Range("int", 1, 12),
    "kind": Range("choice", options=("a", "b", "c")),
}


def loss(p):
    return math.log10(p["rate"] / 0.1) ** 2 + (p["share"] - 1) ** 2 / 4 + (p["depth"] - 5) ** 2 / 20 + (p["kind"] != "b") * 0.5


def history(count=30, seed=3):
    rng = random.Random(seed)
    out = []
    for n in range(count):
        params = {k: r.draw(rng) for k, r in SPACE.items()}
        out.append(Trial(n, params, [loss(params)], COMPLETE))
    return out


def plain_log(span, values, weights, at):
    """Log density on a fine grid: the cut bumps are normalised by sums."""
    if span.kind == "choice":
        mass = {o: 1 / len(span.options) + sum(w for v, w in zip(values, weights) if v == o) for o in span.options}
        return math.log(mass[at] / sum(mass.values()))
    to = np.log if span.kind == "log" else float
    half = 0.5 if span.kind == "int" else 0.0
    low, high = to(span.low) - half, to(span.high) + half
    points = sorted([(float(to(v)), w, 0) for v, w in zip(values, weights)] + [((low + high) / 2, 1.0, 1)])
    grid = np.linspace(low, high, 200_001)
    whole, step = 0.0, grid[1] - grid[0]
    for i, (m, w, flat) in enumerate(points):
        gaps = [abs(points[j][0] - m) for j in (i - 1, i + 1) if 0 <= j < len(points)]
        s = high - low if flat else min(high - low, max([*gaps, (high - low) / min(100, 1 + len(points))]))
        shape = np.exp(-(((grid - m) / s) ** 2) / 2)
        shape /= (shape.sum() - (shape[0] + shape[-1]) / 2) * step
        if half:
            inside = (grid >= at - half) & (grid <= at + half)
            here = shape[inside]
            density = (here.sum() - (here[0] + here[-1]) / 2) * step
        else:
            density = np.interp(to(at), grid, shape)
        whole += w * density
    return math.log(whole / sum(w for _, w, _ in points))


@pytest.mark.parametrize("name", list(SPACE))
def test_densities_equal_a_plain_version(name):
    span, trials = SPACE[name], history()
    values, weights = [t.params[name] for t in trials], [0.5] * 5 + [1.0] * 25
    density = Density(span, values, weights)
    rng = random.Random(1)
    for at in [span.draw(rng) for _ in range(20)]:
        assert density.log(at) == pytest.approx(plain_log(span, values, weights, at), abs=2e-4)
    if span.kind in ("int", "choice"):  # masses of all values add up to one
        every = span.options if span.kind == "choice" else range(int(span.low), int(span.high) + 1)
        assert sum(math.exp(density.log(v)) for v in every) == pytest.approx(1)


def test_draws_follow_the_density():
    density = Density(SPACE["depth"], [2, 2, 3, 9], [1.0] * 4)
    rng = random.Random(5)
    draws = [density.draw(rng) for _ in range(20_000)]
    for v in range(1, 13):
        assert draws.count(v) / 20_000 == pytest.approx(math.exp(density.log(v)), abs=0.012)


@pytest.mark.parametrize("lower", [True, False])
def test_next_set_is_the_best_ratio_of_the_draws(lower):
    trials = history()
    sampler = Sampler(SPACE, "s", lower)
    order = sorted(trials, key=lambda t: t.mean if lower else -t.mean)
    good, rest = sorted(order[:3], key=lambda t: t.number), sorted(order[3:], key=lambda t: t.number)
    rng, expected = random.Random("s-30"), {}
    for name, span in SPACE.items():
        ramp = [1 / 27, 1.0]  # 27 trials: the two oldest weigh less
        one = ([t.params[name] for t in good], [1.0] * 3)
        two = ([t.params[name] for t in rest], ramp + [1.0] * 25)
        draws = [Density(span, *one).draw(rng) for _ in range(CANDIDATES)]
        expected[name] = max(draws, key=lambda v: plain_log(span, *one, v) - plain_log(span, *two, v))
    assert sampler.ask(30, trials) == expected


def ran(seed, method, trials=40):
    sampler = Sampler(SPACE, seed, True, method)
    return search(sampler, lambda jobs: [loss(t.params) for t, _ in jobs], trials, 1, 4)


def test_search_repeats_and_beats_random_draws():
    assert ran(1, "tpe") == ran(1, "tpe") != ran(2, "tpe")
    best = {m: [min(t.mean for t in ran(seed, m)) for seed in range(30)] for m in ("tpe", "random")}
    assert np.mean(best["tpe"]) < 0.75 * np.mean(best["random"])
    assert np.median(best["tpe"]) < 0.75 * np.median(best["random"])


def test_trials_below_the_median_end_after_a_fold():
    asked = []

    def score(jobs):
        asked.extend((t.number, f) for t, f in jobs)
        return [float(t.number) for t, _ in jobs]  # later trials are worse

    found = search(Sampler(SPACE, 0, True), score, 8, 3, 4)
    assert [t.state for t in found] == [COMPLETE] * 4 + [PRUNED] * 4
    assert [len(t.folds) for t in found] == [3] * 4 + [1] * 4
    assert sorted(asked) == [(n, f) for n in range(4) for f in range(3)] + [(n, 0) for n in range(4, 8)]
    assert [t.state for t in search(Sampler(SPACE, 0, False), score, 8, 3, 4)] == [COMPLETE] * 8
    assert [t.state for t in search(Sampler(SPACE, 0, True), score, 8, 3, 4, prune=False)] == [COMPLETE] * 8
    assert not below_median(found[7], found[:3], True) and below_median(Trial(9, {}, [math.nan]), found, True)


def test_ended_trials_rank_after_complete_ones():
    trials = [Trial(0, {}, [5.0, 5.0], COMPLETE), Trial(1, {}, [1.0], PRUNED), Trial(2, {}, [3.0, 1.5], PRUNED), Trial(3, {}, [4.0, 4.0], COMPLETE), Trial(4, {}, [], FAILED)]
    assert [t.number for t in Sampler({}, 0, True).ranked(trials)] == [3, 0, 2, 1]


def test_time_limit_and_failures():
    now = iter(range(100))
    found = search(Sampler(SPACE, 0, True), lambda jobs: [1.0] * len(jobs), 50, 3, 2, timeout=3.5, clock=lambda: next(now))
    assert [t.state for t in found] == [COMPLETE, COMPLETE, STOPPED, STOPPED][: len(found)] and 2 <= len(found) <= 4
    late = search(Sampler(SPACE, 0, True), lambda jobs: [1.0] * len(jobs), 5, 3, 2, timeout=0.0)
    assert [(t.state, len(t.folds)) for t in late] == [(STOPPED, 1)] * 2

    def odd_fail(jobs):
        return [ValueError("no fit") if t.number % 2 else 1.0 for t, _ in jobs]

    found = search(Sampler(SPACE, 0, True), odd_fail, 6, 2, 3)
    assert [t.state for t in found] == [COMPLETE, FAILED] * 3 and found[1].error == "ValueError: no fit"
    with pytest.raises(ValueError, match="unknown search method"):
        Sampler(SPACE, 0, True, "grid")


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(2 * a + rng.normal())) for i, a in enumerate(rng.normal(size=90))]
    folded = kfold(spark.createDataFrame(rows, "id long, x double, label double"), ["id"], 3).persist()
    yield fold_frames(folded, lambda d: prep.fit_preprocessing(d, ["x"], []), "regression", 3)
    folded.unpersist()


def test_tuning_is_repeatable_and_keeps_its_trials(frames):
    one, two = (tune("Ridge", "regression", frames, "rmse", trials=13, parallelism=p) for p in (5, 5))
    assert one == two and len(one.trials) == 13
    complete = [t for t in one.trials if t.state == COMPLETE]
    assert one.score == min(t.mean for t in complete) and all(len(t.folds) < 3 for t in one.trials if t.state == PRUNED)
    assert len(tune("LinearRegression", "regression", frames, "rmse").trials) == 1  # nothing to search


def test_one_failing_trial_does_not_end_the_search(frames, monkeypatch):
    plain = tuning._fold_score

    def sometimes(name, task, params, *rest):
        if params["alpha"] > 1:
            raise RuntimeError("lost")
        return plain(name, task, params, *rest)

    monkeypatch.setattr(tuning, "_fold_score", sometimes)
    found = tune("Ridge", "regression", frames, "rmse", trials=6)
    assert {t.state for t in found.trials} >= {FAILED, COMPLETE} and found.params["alpha"] <= 1
    monkeypatch.setattr(tuning, "_fold_score", lambda *a: 1 / 0)
    with pytest.raises(ValueError, match="no trial of Ridge was scored: ZeroDivisionError"):
        tune("Ridge", "regression", frames, "rmse", trials=3)


def test_report_holds_the_trials_and_the_budget_ends_searches(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(3 * a + rng.normal() / 9)) for i, a in enumerate(rng.normal(size=60))]
    df, store = spark.createDataFrame(rows, "id long, x double, y double"), Store(spark, str(tmp_path))
    config = {
        "dataset_settings": {"cross_validation_folds": 2, "problem_type_override": "regression"},
        "model_selection": {"list_of_models_to_train": ["Ridge"]},
        "hyperparameter_optimization": {"number_of_trials": 3},
        "explainability": {"enable_shap": False},
    }
    outcome = run(df, config, store, key=["id"])
    (trained,) = store.report(outcome.run_id)["trained"]
    assert [t["number"] for t in trained["trials"]] == [0, 1, 2] and trained["params"] in [t["params"] for t in trained["trials"]]
    late = run(df, {**config, "training_strategy": {"time_budget": -1.0}}, key=["id"])
    assert late.training.results[0].error == "the time was up before the search" and late.training.results[0].metrics["r2"] > 0.9
