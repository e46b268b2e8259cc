"""Exact interpolated quantiles that do not depend on one task's memory.

The built-in ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here
each wanted rank is first bracketed with the bounded ``percentile_approx`` sketch and the rows under
the bracket are counted; that is repeated until few rows are left inside. Only those are then
counted by value and ranked. A table that is small to begin with goes straight to the ranking.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import as_double

SKETCH_ACCURACY = 10_000
MARGIN = 2.0 / SKETCH_ACCURACY
BRACKET_ROWS = 2_000_000


@dataclass(frozen=True)
class _Bracket:
    """Values of one column between two bounds, with the number of rows below and inside."""

    column: str
    low: float
    high: float
    below: int
    inside: int

    @property
    def open(self) -> bool:
        return self.low < self.high

    def holds(self) -> Column:
        value = as_double(self.column)
        if math.isinf(self.low) and math.isinf(self.high):
            return value.isNotNull()
        return value.between(F.lit(self.low), F.lit(self.high))


@dataclass
class _Slot:
    """One wanted quantile: the 0-based ranks it lies between and the bracket that holds them."""

    prob: float
    rank_low: int
    rank_high: int
    weight: float
    bracket: _Bracket


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], bracket_rows: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles by linear interpolation between order statistics, nulls left out."""
    if not columns:
        return {}
    counts = df.agg(*[F.count(as_double(c)) for c in columns]).first()
    slots = []
    for c, rows in zip(columns, counts):
        if rows:
            whole = _Bracket(c, -math.inf, math.inf, 0, rows)
            slots += [_make_slot(p, whole) for p in probs]
    while _narrow(df, slots, bracket_rows):
        pass
    found = _ranked_values(df, slots) if slots else {}
    return {c: [found.get((c, p)) for p in probs] for c in columns}


def exact_medians(df: DataFrame, columns: Sequence[str], **kwargs) -> dict[str, float | None]:
    return {c: values[0] for c, values in exact_quantiles(df, columns, [0.5], **kwargs).items()}


def _make_slot(prob: float, bracket: _Bracket) -> _Slot:
    position = prob * (bracket.inside - 1)
    low = math.floor(position)
    return _Slot(prob, low, min(low + 1, bracket.inside - 1), position - low, bracket)


def _narrow(df: DataFrame, slots: list[_Slot], bracket_rows: int) -> bool:
    """One round of shrinking the brackets that are too full; false if none shrinks any more."""
    full = [s for s in slots if s.bracket.open and s.bracket.inside > bracket_rows]
    if not full:
        return False
    brackets = list(dict.fromkeys(s.bracket for s in full))
    sketches, places = [], {}
    for i, b in enumerate(brackets):
        wanted = []
        for s in full:
            if s.bracket == b:
                places[id(s)] = (i, len(wanted))
                start = max((s.rank_low - b.below) / b.inside - MARGIN, 0.0)
                stop = min((s.rank_high - b.below + 1) / b.inside + MARGIN, 1.0)
                wanted += [start, stop]
        sketches.append(F.percentile_approx(F.when(b.holds(), as_double(b.column)), wanted, SKETCH_ACCURACY))
    bounds = df.agg(*sketches).first()
    guesses = [(bounds[i][j], bounds[i][j + 1]) for i, j in (places[id(s)] for s in full)]
    # Slots of a column with few values share their bounds, which are counted once.
    counted = {key: k for k, key in enumerate(dict.fromkeys((s.bracket.column, *g) for s, g in zip(full, guesses)))}
    tallies = []
    for c, low, high in counted:
        value = as_double(c)
        tallies += [F.count_if(value < F.lit(low)), F.count_if(value.between(F.lit(low), F.lit(high)))]
    tally = df.agg(*[t.alias(f"t{k}") for k, t in enumerate(tallies)]).first()
    shrunk = False
    for s, (low, high) in zip(full, guesses):
        k = counted[s.bracket.column, low, high]
        below, inside = tally[2 * k], tally[2 * k + 1]
        if below <= s.rank_low and s.rank_high < below + inside < below + s.bracket.inside:
            s.bracket = _Bracket(s.bracket.column, low, high, below, inside)
            shrunk = True
    return shrunk


def _ranked_values(df: DataFrame, slots: list[_Slot]) -> dict[tuple[str, float], float]:
    """Read the order statistics of every slot from the value counts inside its bracket.

    A bracket of one value needs no counting, and rows outside all brackets are left out before they are laid out.
    """
    brackets = list(dict.fromkeys(s.bracket for s in slots))
    values = {(i, r - b.below): b.low + 0.0 for i, b in enumerate(brackets) if not b.open for s in slots if s.bracket == b for r in (s.rank_low, s.rank_high)}
    spans = {i: b for i, b in enumerate(brackets) if b.open}
    if spans:
        values |= _counted_values(df, slots, spans)
    result = {}
    for s in slots:
        i = brackets.index(s.bracket)
        low, high = values[i, s.rank_low - s.bracket.below], values[i, s.rank_high - s.bracket.below]
        result[s.bracket.column, s.prob] = low + (high - low) * s.weight
    return result


def _counted_values(df: DataFrame, slots: list[_Slot], brackets: dict[int, _Bracket]) -> dict[tuple[int, int], float]:
    """The values at the wanted places inside each bracket."""
    inside = reduce(or_, (b.holds() for b in brackets.values()))
    entries = F.array(
        *[
            F.when(b.holds(), F.struct(F.lit(i).alias("b"), as_double(b.column).alias("value")))
            for i, b in brackets.items()
        ]
    )
    counted = df.where(inside).select(F.inline(entries)).where(F.col("b").isNotNull()).groupBy("b", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = Window.partitionBy("b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = (F.sum("n").over(upto) - 1).alias("last")
    ranked = counted.select("b", "value", "n", last).withColumn("first", F.col("last") - F.col("n") + 1)
    ranks = {i: sorted({r - b.below for s in slots if s.bracket == b for r in (s.rank_low, s.rank_high)}) for i, b in brackets.items()}
    wanted = F.create_map(*[part for i, rs in ranks.items() for part in (F.lit(i), F.array(*[F.lit(r) for r in rs]))])
    hits = ranked.where(
        F.exists(wanted[F.col("b")], lambda r: (r >= F.col("first")) & (r <= F.col("last")))
    ).collect()
    return {(h["b"], r): h["value"] for h in hits for r in ranks[h["b"]] if h["first"] <= r <= h["last"]}
