"""Searches against brute force, with ties, copies and broken vectors."""

import math

import numpy as np

from tabwright.llm.graph_search import nearest
from tabwright.llm.mtree import top_products

SCHEMA = "vec_id long, embedding array<float>, score string, shard int"


def rows(count=1500, size=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size))
    data = (centres[rng.integers(0, 8, count)] + 0.7 * rng.normal(size=(count, size))).astype(np.float32)
    data[100:400] = data[7]  # one very common vector
    out = [(n, v.tolist(), "x", 1) for n, v in enumerate(data)]
    out[50] = (50, None, "x", 1)
    out[51] = (51, [0.0] * size, "x", 1)
    out[52] = (52, [math.nan] + [0.5] * (size - 1), "x", 1)
    out[53] = (53, [None] + [0.5] * (size - 1), "x", 1)
    out[54] = (54, [math.inf] * size, "x", 1)
    out[55] = (55, [], "x", 1)
    out[56] = (56, [1.0, 2.0], "x", 1)
    return [*out, out[60], (None, out[1][1], "x", 1), (5000, [1.0, 2.0], "x", 1), (100000, [-300000.0] * size, "x", 1)]


def whole(values, zero_ok):
    if not values or any(v is None or not math.isfinite(v) for v in values):
        return False
    return zero_ok or any(values)


def brute(data, score, zero_ok):
    good = {i: v for i, v, *_ in data if i is not None and whole(v, zero_ok)}
    out = {}
    for q, v in good.items():
        if q % 50 == 0:
            scored = sorted((-score(v, w), i) for i, w in good.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:5]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_products_are_exact(spark):
    def product(a, b):
        return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))

    data = rows()
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in data]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    expected = brute(data, product, True)
    assert found(top_products(df)) == {q: r for q, r in expected.items() if r}


def test_large_products_are_exact_and_larger_ones_left_out(spark):
    big = float(1 << 22)
    data = [(n, [big + n, -big, float(n)]) for n in range(0, 200)] + [(300, [1e30, 0.0, 0.0]), (350, [-1e30, 1e30, 0.0]), (400, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in data if i < 300}
    expected = {}
    for q in range(0, 200, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)
        expected[q] = [(i, -s) for s, i in scored[:5]]
    assert min(s for r in expected.values() for _, s in r) > 2**60 and found(top_products(df)) == expected


def test_graph_finds_nearest(spark):
    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    data = rows()
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *r) for i, v, *r in data]
    out, expected = found(nearest(spark.createDataFrame(data, SCHEMA).repartition(3))), brute(data, cosine, False)
    expected = {q: r for q, r in expected.items() if r}
    assert set(out) == set(expected)
    good = {i: v for i, v, *_ in data if i is not None}
    hits = total = 0
    for q, hit in out.items():
        assert all(abs(s - cosine(good[q], good[i])) < 1e-9 for i, s in hit) and len(hit) == len(expected[q])
        least = expected[q][-1][1] - 1e-12
        hits += sum(s >= least for _, s in hit)
        total += len(hit)
    assert hits / total >= 0.95
    assert [i for i, _ in out[100]] == [7, 101, 102, 103, 104]  # copies: smallest ids first


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty).count() == 0 and top_products(empty).count() == 0
