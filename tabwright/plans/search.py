"""Parameter search by a tree-structured Parzen estimator, with trials ended early by the median rule.

Finished trials are parted into the good ones, a tenth, and the rest. For each parameter one density is laid over the
values of the good trials and one over the others. Of some draws from the first, that one is tried next for which the
first density is largest against the second (Bergstra et al. 2011). Every trial draws from a generator of its own, so a
search gives the same trials again however its jobs were scheduled.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist, median
from typing import Any

from tabwright.models.catalog import Range

# Trials drawn at random first, draws compared, share and greatest number of good trials, newest
# trials of full weight, and the trials that must be complete before one is ended early.
STARTUP_TRIALS = 10
CANDIDATES = 24
GOOD_SHARE = 0.1
GOOD_MOST = 25
FULL_WEIGHT = 25
PRUNE_AFTER = 4

COMPLETE, PRUNED, STOPPED, FAILED = "complete", "pruned", "stopped", "failed"


@dataclass
class Trial:
    """One parameter set: its score on each fold tried so far and how it ended."""

    number: int
    params: dict[str, Any]
    folds: list[float] = field(default_factory=list)
    state: str = STOPPED
    error: str | None = None

    @property
    def mean(self) -> float:
        return sum(self.folds) / len(self.folds) if self.folds else math.nan


class Density:
    """Density of one parameter around observed values.

    Numbers: normal bumps cut at the ends of the range, one for each value, as wide as the gap to the farther
    neighbour, and a flat one over the whole range. Logarithmic ranges are worked on as logarithms. Whole numbers have
    the mass of the unit around them. Choices: their shares, none of which is zero.
    """

    def __init__(self, span: Range, values: Sequence[Any], weights: Sequence[float]):
        self.span = span
        if span.kind == "choice":
            share = {o: 1.0 / len(span.options) for o in span.options}
            for value, weight in zip(values, weights, strict=True):
                share[value] += weight
            total = sum(share.values())
            self.shares = {o: s / total for o, s in share.items()}
            return
        low, high = self._inner(span.low), self._inner(span.high)
        self.half = 0.5 if span.kind == "int" else 0.0
        self.low, self.high = low - self.half, high + self.half
        width = (self.high - self.low) or 1.0
        middle = (self.low + self.high) / 2
        bumps = sorted([(self._inner(v), w, False) for v, w in zip(values, weights, strict=True)] + [(middle, 1.0, True)])
        least = width / min(100.0, 1.0 + len(bumps))
        self.bumps = []
        for i, (centre, weight, flat) in enumerate(bumps):
            gaps = [abs(bumps[j][0] - centre) for j in (i - 1, i + 1) if 0 <= j < len(bumps)]
            spread = width if flat else min(max([*gaps, least]), width)
            bump = NormalDist(centre, spread)
            inside = bump.cdf(self.high) - bump.cdf(self.low)
            self.bumps.append((weight, bump, inside))
        self.total = sum(w for w, *_ in self.bumps)

    def _inner(self, value: float) -> float:
        return math.log(value) if self.span.kind == "log" else float(value)

    def draw(self, rng: random.Random) -> Any:
        if self.span.kind == "choice":
            return rng.choices(list(self.shares), list(self.shares.values()))[0]
        _, bump, inside = rng.choices(self.bumps, [w for w, *_ in self.bumps])[0]
        at = bump.cdf(self.low) + inside * rng.random()
        value = bump.inv_cdf(min(max(at, 1e-12), 1 - 1e-12))
        value = min(max(value, self.low), self.high)
        if self.span.kind == "int":
            return min(max(round(value), int(self.span.low)), int(self.span.high))
        value = math.exp(value) if self.span.kind == "log" else value
        return min(max(value, self.span.low), self.span.high)

    def log(self, value: Any) -> float:
        if self.span.kind == "choice":
            return math.log(self.shares[value])
        at, sum_ = self._inner(value), 0.0
        for weight, bump, inside in self.bumps:
            if inside <= 0:
                continue
            mass = bump.cdf(at + self.half) - bump.cdf(at - self.half) if self.half else bump.pdf(at)
            sum_ += weight / self.total * mass / inside
        return math.log(max(sum_, 1e-300))


class Sampler:
    """Next parameter set from the trials so far; ``method`` is ``tpe`` or ``random``."""

    def __init__(self, ranges: Mapping[str, Range], seed: int | str, lower_is_better: bool, method: str = "tpe", startup: int = STARTUP_TRIALS):
        if method not in ("tpe", "random"):
            raise ValueError(f"unknown search method {method!r}; use tpe or random")
        self.ranges, self.seed, self.sign, self.method, self.startup = ranges, seed, 1 if lower_is_better else -1, method, startup

    def ranked(self, history: Sequence[Trial]) -> list[Trial]:
        """Best first: complete trials by score, then ended ones, those that came further before the others."""
        used = [t for t in history if t.folds and not math.isnan(t.mean)]
        return sorted(used, key=lambda t: (t.state != COMPLETE, -len(t.folds) if t.state != COMPLETE else 0, self.sign * t.mean, t.number))

    def densities(self, history: Sequence[Trial], running: Sequence[Trial] = ()) -> dict[str, tuple[Density, Density]]:
        """Per parameter the density of the good trials and of the rest, which trials still running count to."""
        order = self.ranked(history)
        good = min(math.ceil(GOOD_SHARE * len(order)), GOOD_MOST)
        parts = [sorted(part, key=lambda t: t.number) for part in (order[:good], [*order[good:], *running])]
        out = {}
        for name, span in self.ranges.items():
            out[name] = tuple(Density(span, [t.params[name] for t in part], _weights(len(part))) for part in parts)
        return out

    def ask(self, number: int, history: Sequence[Trial], running: Sequence[Trial] = ()) -> dict[str, Any]:
        rng = random.Random(f"{self.seed}-{number}")
        usable = self.ranked(history)
        if self.method == "random" or len(usable) < self.startup:
            return {name: span.draw(rng) for name, span in self.ranges.items()}
        params = {}
        for name, (good, rest) in self.densities(usable, running).items():
            draws = [good.draw(rng) for _ in range(CANDIDATES)]
            params[name] = max(draws, key=lambda v: good.log(v) - rest.log(v))
        return params


def _weights(count: int) -> list[float]:
    """Trials in order of age: the newest have full weight, older ones less, the oldest next to none."""
    old = max(0, count - FULL_WEIGHT)
    ramp = [1.0] if old == 1 else [1 / count + (1 - 1 / count) * i / (old - 1) for i in range(old)]
    return ramp + [1.0] * (count - old)


def below_median(trial: Trial, history: Sequence[Trial], lower_is_better: bool, prune_after: int = PRUNE_AFTER) -> bool:
    """Whether a trial's mean over its folds is worse than the median of the complete trials' over as many folds."""
    step = len(trial.folds)
    others = [sum(t.folds[:step]) / step for t in history if t.state == COMPLETE and len(t.folds) >= step]
    others = [m for m in others if not math.isnan(m)]
    if len(others) < prune_after:
        return False
    if math.isnan(trial.mean):
        return True
    middle = median(others)
    return trial.mean > middle if lower_is_better else trial.mean < middle


def search(
    sampler: Sampler,
    score: Callable[[list[tuple[Trial, int]]], list[float | Exception]],
    trials: int,
    folds: int,
    batch: int,
    prune: bool = True,
    timeout: float | None = None,
    clock: Callable[[], float] = time.monotonic,
) -> list[Trial]:
    """All trials in order, in batches of ``batch``: parameters are asked for from the batches before, and those of one
    batch keep apart.

    ``score`` gets (trial, fold) jobs to run side by side and gives each one's score or the exception it ended with.
    A batch goes through the folds together; after each fold, trials below the median are ended. Past ``timeout``
    seconds no more folds are begun and open trials are stopped; the first batch's first fold is always run.
    """
    end = None if timeout is None else clock() + timeout
    history: list[Trial] = []
    while len(history) < trials and not (history and end is not None and clock() >= end):
        first = len(history)
        live: list[Trial] = []
        for n in range(first, min(first + batch, trials)):
            live.append(Trial(n, sampler.ask(n, history, live)))
        done = history[:]
        history += live
        for fold in range(folds):
            if (fold or first) and end is not None and clock() >= end:
                break
            for trial, value in zip(live, score([(t, fold) for t in live]), strict=True):
                if isinstance(value, Exception):
                    trial.state, trial.error = FAILED, f"{type(value).__name__}: {value}"[:2000]
                else:
                    trial.folds.append(value)
                    if fold == folds - 1:
                        trial.state = COMPLETE
            live = [t for t in live if t.state == STOPPED]
            if prune:
                for trial in live:
                    if below_median(trial, done, sampler.sign == 1):
                        trial.state = PRUNED
                live = [t for t in live if t.state == STOPPED]
            if not live:
                break
    return history
