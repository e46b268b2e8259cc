"""The models by task, with the ranges their parameters are searched in."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from typing import Any

# Model names per task.
CLASSIFIERS = (
    "LogisticRegression",
    "RandomForestClassifier",
    "GradientBoostingClassifier",
    "XGBClassifier",
    "LGBMClassifier",
    "SVC",
    "KNeighborsClassifier",
    "GaussianNB",
)
REGRESSORS = (
    "LinearRegression",
    "Ridge",
    "Lasso",
    "RandomForestRegressor",
    "GradientBoostingRegressor",
    "XGBRegressor",
    "LGBMRegressor",
    "SVR",
)


@dataclass(frozen=True)
class Range:
    """Where one parameter is drawn from."""

    kind: str
    low: float = 0.0
    high: float = 0.0
    options: tuple = ()

    def draw(self, rng: random.Random) -> Any:
        if self.kind == "int":
            return rng.randint(int(self.low), int(self.high))
        if self.kind == "log":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        if self.kind == "real":
            return rng.uniform(self.low, self.high)
        return rng.choice(self.options)


def _whole(low: int, high: int) -> Range:
    return Range("int", low, high)


def _real(low: float, high: float) -> Range:
    return Range("real", low, high)


def _log(low: float, high: float) -> Range:
    return Range("log", low, high)


def _one_of(*options: str) -> Range:
    return Range("choice", options=options)


# Search ranges by model family.
_FOREST = {
    "n_estimators": _whole(80, 400),
    "max_depth": _whole(3, 18),
    "min_samples_split": _whole(2, 16),
    "min_samples_leaf": _whole(1, 8),
}
_BOOSTING = {
    "n_estimators": _whole(50, 300),
    "max_depth": _whole(2, 8),
    "learning_rate": _log(0.01, 0.3),
    "subsample": _real(0.6, 1.0),
}
_XGB = {
    "n_estimators": _whole(50, 450),
    "max_depth": _whole(3, 12),
    "learning_rate": _log(0.01, 0.3),
    "subsample": _real(0.6, 1.0),
    "colsample_bytree": _real(0.5, 1.0),
}
_LGBM = {
    "n_estimators": _whole(50, 450),
    "max_depth": _whole(3, 12),
    "learning_rate": _log(0.01, 0.3),
    "num_leaves": _whole(20, 180),
    "subsample": _real(0.6, 1.0),
}
RANGES: dict[str, dict[str, Range]] = {
    "LogisticRegression": {"C": _log(1e-3, 100.0), "solver": _one_of("lbfgs", "saga")},
    "RandomForestClassifier": _FOREST,
    "RandomForestRegressor": _FOREST,
    "GradientBoostingClassifier": _BOOSTING,
    "GradientBoostingRegressor": _BOOSTING,
    "XGBClassifier": _XGB,
    "XGBRegressor": _XGB,
    "LGBMClassifier": _LGBM,
    "LGBMRegressor": _LGBM,
    "SVC": {"C": _log(1e-3, 100.0), "kernel": _one_of("rbf", "poly", "sigmoid"), "gamma": _one_of("scale", "auto")},
    "SVR": {"C": _log(1e-3, 100.0), "kernel": _one_of("rbf", "poly", "sigmoid"), "epsilon": _real(0.01, 1.0)},
    "KNeighborsClassifier": {"n_neighbors": _whole(1, 25), "weights": _one_of("uniform", "distance")},
    "Ridge": {"alpha": _log(1e-4, 100.0)},
    "Lasso": {"alpha": _log(1e-4, 100.0)},
    "GaussianNB": {},
    "LinearRegression": {},
}


def list_models(task: str) -> list[str]:
    return sorted(REGRESSORS if task == "regression" else CLASSIFIERS)


def models_by_task() -> dict[str, list[str]]:
    return {"classification": list_models("classification"), "regression": list_models("regression")}


def check_model(name: str, task: str) -> None:
    if name not in list_models(task):
        raise ValueError(f"unknown model {name!r} for {task}; known are {', '.join(list_models(task))}")


def draw_params(name: str, trials: int, seed: int) -> list[dict[str, Any]]:
    """Seeded parameter sets; one empty set for a model without parameters."""
    ranges = RANGES[name]
    if not ranges:
        return [{}]
    rng = random.Random(f"{seed}-{name}")
    return [{key: r.draw(rng) for key, r in ranges.items()} for _ in range(trials)]
