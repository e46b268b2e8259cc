"""Split, tune, refit and score several models on one table."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import as_double, fold_nan, ref
from tabwright.functions.small import spread
from tabwright.models.build import TrainFacts, build_model, scored_columns
from tabwright.operators.board import board_rows
from tabwright.operators.encode import target_indexer, target_labels, target_names
from tabwright.operators.metrics import check_metric, evaluate, lower_is_better
from tabwright.operators.split import holdout_split, kfold, stratified_kfold, stratified_split
from tabwright.plans.search import Trial
from tabwright.plans.tune import FOLDS, SEED, TRIALS, fold_frames, tune
from tabwright.session import materialise
from tabwright.sources.load import check_rows

ROW_ID = "_row_id"


@dataclass
class Trained:
    """One model: its pipeline from raw columns to prediction, scores on the test part, and how it got there."""

    model: str
    pipeline: PipelineModel
    fitted: Any
    metrics: dict[str, float | None]
    params: dict[str, Any]
    training_time: float
    optimisation_score: float | None = None
    error: str | None = None
    trials: list[Trial] = field(default_factory=list)

    def record(self) -> dict:
        """All but the fitted stages."""
        plain = ("model", "metrics", "params", "training_time", "optimisation_score", "error")
        return {**{n: getattr(self, n) for n in plain}, "trials": [asdict(t) for t in self.trials]}

    @classmethod
    def again(cls, record: dict, pipeline: PipelineModel) -> Trained:
        trials = [Trial(**t) for t in record["trials"]]
        return cls(pipeline=pipeline, fitted=pipeline.stages[1], **{**record, "trials": trials})


@dataclass
class Training:
    task: str
    metric: str
    labels: list[str]
    test: DataFrame
    train_vectors: DataFrame
    results: list[Trained] = field(default_factory=list)

    def board(self) -> DataFrame:
        rows = [{"model": r.model, "training_time": r.training_time, "metrics": r.metrics} for r in self.results]
        return board_rows(self.test.sparkSession, rows, self.task)

    def best(self) -> Trained | None:
        """Best metric in its direction, the faster model on a tie; a missing score ranks last."""
        if not self.results:
            return None
        sign = 1 if lower_is_better(self.metric) else -1

        def place(r: Trained):
            value = r.metrics.get(self.metric)
            return (value is None, sign * (value or 0.0), r.training_time)

        return min(self.results, key=place)


def prepare_rows(df: DataFrame, target: str, task: str, key: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop rows without a target, number the rest if they have no key, and write ``label``.

    Numbered rows are materialised at once: the numbers must not move when a task is run again.
    """
    rows = fold_nan(df).where(ref(target).isNotNull())
    if not key:
        rows = materialise(rows.withColumn(ROW_ID, F.monotonically_increasing_id()))
    if task == "classification":
        labels = target_labels(rows, target)
        return target_indexer(labels, target).transform(rows), labels
    return rows.withColumn("label", as_double(target)), []


def split_rows(
    rows: DataFrame, task: str, key: Sequence[str], share: float, folds: int, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Train part with its ``fold`` numbers and test part, stratified for classes."""
    if task == "classification":
        marked = stratified_split(rows, "label", key, share, seed)
    else:
        marked = holdout_split(rows, key, share, seed)
    train, test = marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    if task == "classification":
        return stratified_kfold(train, "label", key, folds, seed), test
    return kfold(train, key, folds, seed), test


def train_all(
    df: DataFrame,
    target: str,
    task: str,
    models: Sequence[str],
    fit_prep: Callable[[DataFrame], PipelineModel],
    metric: str | None = None,
    trials: int = TRIALS,
    folds: int = FOLDS,
    share: float = 0.2,
    key: Sequence[str] | None = None,
    seed: int = SEED,
    parallelism: int = 4,
    on_model: Callable[[int, str], None] | None = None,
    method: str = "tpe",
    prune: bool = True,
    timeout: float | None = None,
    time_budget: float | None = None,
    done: Mapping[int, tuple[dict, PipelineModel]] | None = None,
    on_trained: Callable[[int, Trained], None] | None = None,
) -> Training:
    """Tune each model on the train part, refit it there with the best parameters, score it on the test part.

    If tuning fails the model is fitted with its defaults and the error text is kept. ``timeout`` ends each model's
    search, ``time_budget`` all searches together; models after that are fitted with their defaults. ``done`` holds
    records and pipelines of models of an earlier, ended run by position: they are taken as they are. ``on_trained`` is
    told of each other one.
    """
    begun = time.monotonic()
    metric = check_metric(metric, task)
    check_rows(df, folds=folds)
    rows, labels = prepare_rows(df, target, task, key)
    train, test = split_rows(rows, task, list(key or [ROW_ID]), share, folds, seed)
    train, test = spread(train).persist(), spread(test).persist()
    prep = fit_prep(train)
    vectors = prep.transform(train).select("features", "label").persist()
    test_vectors = prep.transform(test).select("features", "label").persist()
    facts = TrainFacts.of(vectors, task)
    classes = len(labels)
    facts = TrainFacts(facts.rows, classes, facts.label_std)
    training = Training(task, metric, labels, test, vectors)
    frames = fold_frames(train, fit_prep, task, folds) if trials else []
    try:
        for i, name in enumerate(models):
            if i in (done or {}) and done[i][0]["model"] == name:
                training.results.append(Trained.again(*done[i]))
                continue
            if on_model:
                on_model(i, name)
            start = time.time()
            params, score, error, tried = {}, None, None, []
            limits = [t for t in (timeout, None if time_budget is None else time_budget - (time.monotonic() - begun)) if t is not None]
            limit = min(limits, default=None)
            if trials and limit is not None and limit <= 0:
                error = "the time was up before the search"
            elif trials:
                try:
                    tuned = tune(name, task, frames, metric, classes, trials, seed, parallelism, method, prune, limit)
                    params, score, tried = tuned.params, tuned.score, tuned.trials
                except Exception as failure:  # the model may still train with its defaults
                    error = f"{type(failure).__name__}: {failure}"[:2000]
            fitted = build_model(name, task, params, facts).fit(vectors)
            metrics = evaluate(scored_columns(fitted.transform(test_vectors)), task, classes)
            stages = [prep, fitted] + ([target_names(labels)] if labels else [])
            trained = (
                Trained(name, PipelineModel(stages), fitted, metrics, params, time.time() - start, score, error, tried)
            )
            training.results.append(trained)
            if on_trained:
                on_trained(i, trained)
    finally:
        train.unpersist()
        test_vectors.unpersist()
    return training
