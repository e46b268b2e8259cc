"""Information by neighbours against all pairs of rows, with ties, gaps and ranges that split neighbourhoods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import information
from tabwright.operators.information import class_information, counts_between, digamma, nearest_in_plane, neighbour_information, plane_distances, reach
from tabwright.operators.select import select_features

PSI = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain_classes(c, x, k=3):
    gaps = np.abs(x[:, None] - x[None])
    same = c[:, None] == c[None]
    np.fill_diagonal(same, False)
    keep = np.flatnonzero(same.any(1))
    terms = []
    for i in keep:
        own = np.sort(gaps[i, same[i]])
        r = own[min(k, len(own)) - 1]
        inside = [j for j in keep if j != i and gaps[i, j] <= r]
        terms.append(PSI((own <= r).sum()) - PSI(len(inside)) - PSI(len(own) + 1))
    return max(0.0, PSI(len(keep)) + np.mean(terms)) if len(keep) else None


def plain_plane(x, y, k=3):
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    both, terms = np.maximum(dx, dy), []
    for i in range(len(x)):
        others = np.sort(np.delete(both[i], i))
        r, near = others[min(k, len(others)) - 1], min(k, len(others))
        if r == 0:
            terms.append(PSI((others == 0).sum()) - PSI((dx[i] == 0).sum() - 1) - PSI((dy[i] == 0).sum() - 1))
        else:
            terms.append(PSI(near) - PSI((dx[i] < r).sum()) - PSI((dy[i] < r).sum()))
    return max(0.0, PSI(len(x)) + np.mean(terms))


def numbers(kind, count, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=count)
    if kind == "ties":
        return np.round(x, 1)
    if kind == "few":
        return rng.integers(0, 4, count).astype(float)
    if kind == "one":  # a third of the rows share a value
        x[rng.random(count) < 0.34] = 0.5
    return x


def test_digamma(spark):
    rows = spark.range(1, 400).select("id", digamma(F.col("id").cast("double")).alias("v")).collect()
    assert all(abs(r["v"] - PSI(r["id"])) < 1e-13 for r in rows)


def test_bounds_hold_exactly_what_is_within():
    rng = np.random.default_rng(0)
    x, other = rng.normal(size=2000) * 10.0 ** rng.integers(-3, 3, 2000), rng.normal(size=2000)
    x[:40], other[:40] = np.arange(40) - 20, 2 * (np.arange(40) - 20)  # bounds at zero
    for distance in (np.abs(other - x), np.zeros(2000)):
        for strict in (np.zeros(2000, bool), distance > 0):
            lo, hi = reach(x, distance, strict)
            for end, out in ((lo, -np.inf), (hi, np.inf)):
                beyond = np.nextafter(end, out)
                ok = lambda v: np.where(strict, np.abs(v - x) < distance, np.abs(v - x) <= distance)
                assert ok(end).all() and not ok(beyond).any()


def test_counts_between_bounds(spark, monkeypatch):
    monkeypatch.setattr(information, "RANGE_ROWS", 50)
    monkeypatch.setattr(information.range_sorted, "__defaults__", (50,))
    rng = np.random.default_rng(3)
    points = [(int(a), float(v), int(n)) for a, v, n in zip(rng.integers(0, 3, 300), rng.integers(0, 20, 300), rng.integers(1, 5, 300))]
    queries = [(str(i), int(a), float(lo), float(lo + w)) for i, (a, lo, w) in enumerate(zip(rng.integers(0, 3, 100), rng.integers(-2, 22, 100), rng.integers(0, 9, 100)))]
    df = counts_between(spark.createDataFrame(points, "axis int, v double, n long"), spark.createDataFrame(queries, "id string, axis int, lo double, hi double"))
    assert {r["id"]: r["inside"] for r in df.collect()} == {q: sum(n for b, v, n in points if b == a and lo <= v <= hi) for q, a, lo, hi in queries}


@pytest.mark.parametrize("rows", [65_536, 40, 2])
@pytest.mark.parametrize("kind", ["plain", "ties", "few", "one"])
def test_classes_equal_all_pairs(spark, monkeypatch, kind, rows):
    """Also where the ranges hold fewer rows than there are neighbours."""
    monkeypatch.setattr(information.range_sorted, "__defaults__", (rows,))
    rng = np.random.default_rng(5)
    x = np.stack([numbers(kind, 150), numbers("plain", 150, 2)])
    c = (x[0] > 0.4).astype(int) + (rng.random(150) < 0.05) * 7
    c[:2] = (100, 101)  # classes of one row
    entries = spark.createDataFrame([(f, int(c[i]) << 40, float(x[f, i])) for f in range(2) for i in range(150)], "f int, c long, x double")
    found = {r["f"]: r["mi"] for r in class_information(entries).collect()}
    assert found == pytest.approx({f: plain_classes(c, x[f]) for f in range(2)}, abs=1e-10)


def test_walk_outwards_finds_the_nearest():
    rng = np.random.default_rng(7)
    for x, y in ((numbers("few", 300), numbers("plain", 300)), (numbers("plain", 300), numbers("ties", 300, 3)), (numbers("few", 300), numbers("few", 300, 9))):
        n = rng.integers(1, 4, 300)
        gaps = np.repeat(np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y)), n, axis=1)
        assert (nearest_in_plane(x, y, n, x, y, np.full((300, 4), np.inf)) == np.sort(gaps, 1)[:, :4]).all()


@pytest.mark.parametrize("rows", [65_536, 40, 3])
@pytest.mark.parametrize("kind", ["plain", "ties", "few", "one"])
def test_plane_distances_equal_all_pairs(spark, kind, rows):
    x, y = numbers(kind, 150), np.round(numbers("plain", 150, 4), 1 if kind == "few" else 9)
    entries = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(2, 1.0, 2.0), (2, 5.0, 5.0)], "f int, x double, y double")
    gaps = np.sort(np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y)), 1)[:, 1:4]
    expected = {(1, a, b): g.tolist() for a, b, g in zip(x, y, gaps)}
    expected |= {(2, 1.0, 2.0): [4.0, math.inf, math.inf], (2, 5.0, 5.0): [4.0, math.inf, math.inf]}
    found = plane_distances(entries, rows=rows).collect()
    assert {(r["f"], r["x"], r["y"]): r["best"] for r in found} == expected and sum(r["n"] for r in found) == 152


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        y = float(rng.normal())
        rows.append((y + 0.3 * float(rng.normal()), float(rng.normal()), float(i % 3), "hi" if y > 0 else "lo", None if rng.random() < 0.4 and y > 0 else round(y, 1), 3.5, y, i))
    return spark.createDataFrame(rows, "near double, far double, third double, word string, holed double, flat double, y double, id int").repartition(3)


def test_numbers_against_numbers(gaps):
    columns = ["near", "far", "third", "holed", "flat", "word"]
    found = {r["feature"]: r["mi"] for r in neighbour_information(gaps, "y", columns, "regression").collect()}
    t = gaps.toPandas()
    y = t["y"].to_numpy() / t["y"].std(ddof=0)
    for c in ("near", "far", "third"):
        x = t[c].to_numpy()
        assert found[c] == pytest.approx(plain_plane(x / x.std(), y), abs=1e-9)
    known = t["holed"].notna().to_numpy()
    x = t["holed"].to_numpy()[known]
    expected = plain_plane(x / x.std(), y[known]) * known.mean() + plain_classes((~known).astype(int), y)
    assert found["holed"] == pytest.approx(expected, abs=1e-9)
    assert found["near"] > 0.6 > 0.15 > found["far"] and found["flat"] == pytest.approx(0, abs=1e-9)


def test_numbers_against_classes(gaps):
    columns = ["near", "far", "holed", "flat"]
    found = {r["feature"]: r["mi"] for r in neighbour_information(gaps, "word", columns, "classification").collect()}
    t = gaps.toPandas()
    c = (t["word"] == "hi").to_numpy()
    assert found["near"] == pytest.approx(plain_classes(c, t["near"].to_numpy()), abs=1e-9)
    known = t["holed"].notna().to_numpy()
    table = np.array([[(known & c).sum(), (known & ~c).sum()], [(~known & c).sum(), max((~known & ~c).sum(), 1e-300)]]) / len(t)
    plug = (table * np.log(table / np.outer(table.sum(1), table.sum(0)))).sum()
    assert found["holed"] == pytest.approx(plain_classes(c[known], t["holed"].to_numpy()[known]) * known.mean() + plug, abs=1e-9)
    assert select_features(gaps.select("far", "flat", "near", "word"), "word", "mutual_information", 1) == ["near"]
    assert select_features(gaps.select("far", "flat", "near", "word"), "word", "binned_information", 1) == ["near"]


def test_known_information_is_met(spark):
    """For two normal variables it is -ln(1 - r^2) / 2."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    y = 0.8 * x + 0.6 * rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert neighbour_information(df, "y", ["x"], "regression").first()["mi"] == pytest.approx(-math.log(1 - 0.64) / 2, abs=0.06)


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, w string, y double")
    for task in ("regression", "classification"):
        assert sorted(map(tuple, neighbour_information(df, "y", ["x", "w"], task).collect())) == [("w", 0.0), ("x", 0.0)]
