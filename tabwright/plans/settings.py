"""Settings of a run: a nested dict laid over the defaults."""

from __future__ import annotations

import copy
from collections.abc import Mapping

# Section names, keys and defaults.
DEFAULTS: dict = {
    "dataset_settings": {
        "target_column": None,
        "problem_type_override": None,
        "train_test_split": 0.2,
        "cross_validation_folds": 5,
    },
    "data_cleaning": {
        "missing_value_strategy": "median",
        "categorical_encoding": "onehot",
        "feature_scaling": "standard",
    },
    "outlier_removal": {
        "method": "none",
        "threshold_parameters": {
            "zscore_threshold": 3.0,
            "iqr_multiplier": 1.5,
            "isolation_forest_contamination": 0.05,
        },
    },
    "feature_engineering": {
        "log_transform": False,
        "polynomial_features": False,
        "feature_interactions": False,
        "feature_selection": {"enabled": False, "method": "variance_threshold", "k_features": 20},
    },
    "model_selection": {"list_of_models_to_train": None},
    "hyperparameter_optimization": {"optimization_method": "optuna", "number_of_trials": 20, "timeout": None, "early_stopping": True},
    "training_strategy": {"parallelism": 4, "fit_on": "all", "time_budget": None},
    "evaluation_metrics": {"primary_metric": None},
    "explainability": {"enable_shap": True, "rows": 200},
}


def merged(changes: Mapping | None) -> dict:
    """The defaults with ``changes`` applied section by section; neither input is altered."""
    return _overlay(copy.deepcopy(DEFAULTS), changes or {})


def _overlay(base: dict, changes: Mapping) -> dict:
    for key, value in changes.items():
        if isinstance(value, Mapping) and isinstance(base.get(key), dict):
            _overlay(base[key], value)
        else:
            base[key] = copy.deepcopy(value)
    return base
