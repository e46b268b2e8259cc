"""The whole run: clean, build features, train, rank, save and explain."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, functions as F

from tabwright.functions.columns import column_roles, fold_nan, ref, require_columns
from tabwright.operators.encode import label_encode, level_codes, text_columns
from tabwright.operators.explain import RUN_TOP_K, feature_importance
from tabwright.operators.features import engineer_features
from tabwright.operators.meta import resolve_models
from tabwright.operators.metrics import check_metric
from tabwright.operators.outliers import CONTAMINATION, IQR_MULTIPLIER, ZSCORE_THRESHOLD, remove_outliers
from tabwright.operators.prep import config_preprocessing
from tabwright.operators.profile import problem_type
from tabwright.operators.split import holdout_split, stratified_split
from tabwright.plans.settings import merged
from tabwright.plans.train import ROW_ID, Training, train_all
from tabwright.session import materialise
from tabwright.sources.load import check_rows, check_types
from tabwright.sources.store import MANY_FILES, Store


# Fixed value: the default name of the search method means the Parzen estimator.
SEARCH_METHODS = {"optuna": "tpe"}


@dataclass
class Outcome:
    run_id: str | None
    task: str
    target: str
    models: list[str]
    training: Training
    importance: DataFrame | None

    @property
    def board(self) -> DataFrame:
        return self.training.board()


def prepare_features(df: DataFrame, target: str, task: str, config: Mapping, key: Sequence[str]) -> DataFrame:
    """Outlier removal, feature building and label codes, in that order.

    They learn from all rows, or with ``training_strategy.fit_on = "train"`` from the train part
    of the later split only.
    """
    source = None
    if config["training_strategy"].get("fit_on") == "train":
        share = config["dataset_settings"]["train_test_split"]
        if task == "classification":
            marked = stratified_split(df, target, key, share)
        else:
            marked = holdout_split(df, key, share)
        source = marked.where(~F.col("is_test")).drop("is_test")

    removal = config["outlier_removal"]
    limits = removal.get("threshold_parameters") or {}
    clean = partial(
        remove_outliers,
        target=target,
        method=removal["method"],
        zscore_threshold=float(limits.get("zscore_threshold", ZSCORE_THRESHOLD)),
        iqr_multiplier=float(limits.get("iqr_multiplier", IQR_MULTIPLIER)),
        contamination=float(limits.get("isolation_forest_contamination", CONTAMINATION)),
        key=key,
        fit_on=source,
    )
    df = clean(df)
    source = None if source is None else clean(source)

    built = engineer_features(df, target, config["feature_engineering"], task, key, source)
    if config["data_cleaning"]["categorical_encoding"] != "label":
        return built
    columns = text_columns(built, [target, *key])
    codes = level_codes(built if source is None else source, columns) if columns else None
    return label_encode(built, columns, codes)


def run(
    df: DataFrame,
    config: Mapping | None = None,
    store: Store | None = None,
    dataset_id: str = "",
    key: Sequence[str] | None = None,
    resume: str | None = None,
) -> Outcome:
    """Train and rank models on one table.

    ``key`` names columns that identify a row and are not features; without it rows are numbered.
    With a ``store`` the run's status, model, leaderboard, report and importances are saved, and the prepared rows and
    each trained model as soon as they stand. ``resume`` names a run of the store that ended before it was complete: it
    goes on with its own settings, rows and models, and trains the models that are missing.
    """
    settings = merged(config)
    if resume is not None:
        run_id = resume
        state = store.run(resume) if store else None
        if state is None or state["status"] == "completed":
            raise ValueError(f"there is no run {resume} to go on with")
        settings, dataset_id = json.loads(state["config"]), state["dataset_id"]
    else:
        run_id = store.start_run(dataset_id, settings) if store else None

    def report(progress: float, message: str, **more) -> None:
        if store:
            store.update_run(run_id, status="running", progress=progress, message=message, **more)

    try:
        outcome = _execute(df, settings, key, run_id, report, store)
        if store:
            _save(store, run_id, dataset_id, outcome)
            store.compact(MANY_FILES)
        return outcome
    except Exception as failure:
        if store:
            store.update_run(run_id, status="failed", progress=100.0, message=str(failure)[:2000])
        raise


def _execute(df: DataFrame, settings: dict, key: Sequence[str] | None, run_id: str | None, report, store: Store | None) -> Outcome:
    report(5.0, "Loading dataset")
    data = settings["dataset_settings"]
    target = data["target_column"] or df.columns[-1]
    require_columns(df, target, *(key or []))
    check_types(df)
    check_rows(df)
    df = fold_nan(df).where(ref(target).isNotNull())
    if not key:
        df = materialise(df.withColumn(ROW_ID, F.monotonically_increasing_id()))
    by = list(key or [ROW_ID])
    plain = df.drop(*by)
    task = problem_type(plain, target, data["problem_type_override"])
    metric = check_metric(settings["evaluation_metrics"]["primary_metric"], task)
    report(15.0, "Profiling complete", problem_type=task)

    prepared = _kept(store, run_id, lambda: prepare_features(df, target, task, settings, by))
    plain = prepared.drop(*by)
    report(30.0, "Feature processing complete")

    roles = column_roles(plain, target)
    models = resolve_models(plain, target, task, settings["model_selection"]["list_of_models_to_train"])
    cleaning, tuning = settings["data_cleaning"], settings["hyperparameter_optimization"]
    report(45.0, "Training models")
    training = train_all(
        prepared,
        target,
        task,
        models,
        lambda train: config_preprocessing(train, roles.numerical, roles.categorical, cleaning),
        metric,
        trials=int(tuning["number_of_trials"]),
        folds=int(data["cross_validation_folds"]),
        share=float(data["train_test_split"]),
        key=by,
        parallelism=int(settings["training_strategy"]["parallelism"]),
        method=SEARCH_METHODS.get(tuning["optimization_method"], tuning["optimization_method"]),
        prune=bool(tuning["early_stopping"]),
        timeout=tuning["timeout"],
        time_budget=settings["training_strategy"]["time_budget"],
        done=store.trained(run_id, len(models)) if store else None,
        on_trained=(lambda i, t: store.save_trained(run_id, i, t.record(), t.pipeline)) if store else None,
    )
    importance = None
    best = training.best()
    if best is not None and settings["explainability"]["enable_shap"]:
        vectors = best.pipeline.stages[0].transform(prepared)
        importance = feature_importance(vectors, best.fitted, RUN_TOP_K, settings["explainability"].get("rows"))
    return Outcome(run_id, task, target, models, training, importance)


def _kept(store: Store | None, run_id: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """The prepared rows, written: with the run, so that a later start finds the same ones, or as a checkpoint."""
    if store is None:
        return materialise(make())
    path = store.prepared_path(run_id)
    if not store.has(path):
        make().write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path)


def _save(store: Store, run_id: str, dataset_id: str, outcome: Outcome) -> None:
    training, best = outcome.training, outcome.training.best()
    store.save_model(run_id, best.pipeline)
    store.save_board(run_id, outcome.board, training.metric)
    if outcome.importance is not None:
        store.save_importance(run_id, outcome.importance)
    store.save_report(
        run_id,
        {
            "run_id": run_id,
            "dataset_id": dataset_id,
            "problem_type": outcome.task,
            "target_column": outcome.target,
            "primary_metric": training.metric,
            "models": outcome.models,
            "best_model": best.model,
            "best_metrics": best.metrics,
            "leaderboard": [r.asDict() for r in store.board(run_id).collect()],
            "trained": [r.record() for r in training.results],
        },
    )
    store.update_run(
        run_id,
        status="completed",
        progress=100.0,
        message="Training completed",
        best_model=best.model,
        best_score=best.metrics.get(training.metric),
        metrics=best.metrics,
    )
    store.forget_journal(run_id)
