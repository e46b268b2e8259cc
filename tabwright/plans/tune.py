"""Seeded parameter search by cross-validation, with preprocessing learned per fold."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tabwright.models.build import TrainFacts, build_model, scored_columns
from tabwright.models.catalog import RANGES
from tabwright.operators.metrics import evaluate, lower_is_better
from tabwright.plans.search import COMPLETE, Sampler, Trial, search

# Trials per model, folds, and the seed.
TRIALS = 20
FOLDS = 5
SEED = 42


@dataclass(frozen=True)
class FoldFrames:
    """One fold's training and validation rows as vectors."""

    train: DataFrame
    valid: DataFrame
    facts: TrainFacts


@dataclass
class Tuning:
    model: str
    params: dict[str, Any] = field(default_factory=dict)
    score: float | None = None
    trials: list[Trial] = field(default_factory=list)


def fold_frames(
    train: DataFrame, fit_prep: Callable[[DataFrame], PipelineModel], task: str, folds: int
) -> list[FoldFrames]:
    """Learn each fold's preprocessing once; all models and trials then share it.

    The vectors are not kept, which would hold the table once per fold: the stages are narrow and
    run again over ``train``, which the caller should have persisted.
    """

    @inheritable_thread_target(train.sparkSession)
    def prepare(i: int) -> FoldFrames:
        rest, held = train.where(F.col("fold") != i), train.where(F.col("fold") == i)
        prep = fit_prep(rest)
        vectors = prep.transform(rest).select("features", "label")
        return FoldFrames(vectors, prep.transform(held).select("features", "label"), TrainFacts.of(vectors, task))

    with ThreadPoolExecutor(max_workers=folds) as pool:
        return list(pool.map(prepare, range(folds)))


def cross_validate(name: str, task: str, params: dict, frames: list[FoldFrames], metric: str, classes: int) -> list[float]:
    """Score of one parameter set on each fold; the folds run side by side."""

    @inheritable_thread_target(frames[0].train.sparkSession)
    def score(frame: FoldFrames) -> float:
        return _fold_score(name, task, params, frame, metric, classes)

    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        return list(pool.map(score, frames))


def _fold_score(name: str, task: str, params: dict, frame: FoldFrames, metric: str, classes: int) -> float:
    facts = TrainFacts(frame.facts.rows, max(classes, frame.facts.classes), frame.facts.label_std)
    model = build_model(name, task, params, facts).fit(frame.train)
    value = evaluate(scored_columns(model.transform(frame.valid)), task, classes, only=metric)[metric]
    return math.nan if value is None else value


def tune(
    name: str,
    task: str,
    frames: list[FoldFrames],
    metric: str,
    classes: int = 0,
    trials: int = TRIALS,
    seed: int = SEED,
    parallelism: int = 4,
    method: str = "tpe",
    prune: bool = True,
    timeout: float | None = None,
) -> Tuning:
    """Search the model's ranges and keep the complete trial with the best mean over the folds.

    ``parallelism`` trials are asked for at once and their fits submitted side by side; each is an ordinary Spark job.
    A model without parameters has one trial. A trial that fails is recorded with its error; if none is complete the
    search fails. ``method`` is ``tpe`` or ``random``, ``prune`` ends trials below the median after a fold, and past
    ``timeout`` seconds no more folds are begun.
    """
    ranges = RANGES[name]
    sampler = Sampler(ranges, f"{seed}-{name}", lower_is_better(metric), method)

    @inheritable_thread_target(frames[0].train.sparkSession)
    def run(job: tuple[Trial, int]) -> float | Exception:
        trial, fold = job
        try:
            return _fold_score(name, task, trial.params, frames[fold], metric, classes)
        except Exception as failure:  # other trials go on
            return failure

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        found = search(sampler, lambda jobs: list(pool.map(run, jobs)), trials if ranges else 1, len(frames), parallelism, prune, timeout)
    usable = [t for t in found if t.state == COMPLETE and not math.isnan(t.mean)]
    if not usable:
        why = next((t.error for t in found if t.error), "the time was up" if timeout is not None else f"there is no {metric}")
        raise ValueError(f"no trial of {name} was scored: {why}")
    best = sampler.ranked(usable)[0]
    return Tuning(name, best.params, best.mean, found)
