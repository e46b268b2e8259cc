"""Codes and codebooks against rounds that compare every part with every entry."""

import hashlib
import math

import numpy as np
import pytest

from tabwright.llm.ball_codes import books_digest, codes_and_books, compressed, distances, reassign, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(data, entries, rounds=4, parts=4):
    """Rows (id, label, whole numbers) to codes, errors and books."""
    first = {}
    for i, _, x in data:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    width = len(data[0][2]) // parts
    rows = np.array([x for *_, x in data], object).reshape(len(data), parts, width)
    books = np.array([first[i] for i in sorted(first)[:entries]], object).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    codes, error = np.zeros((len(data), parts), int), [0] * len(data)
    for n in range(rounds + 1):
        error = [0] * len(data)
        for r in range(len(data)):
            for p in range(parts):
                best, code = min((int(((rows[r, p] - e) ** 2).sum()), k) for k, e in enumerate(books[p]))
                codes[r, p], error[r] = code, error[r] + best
        if n < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = rows[codes[:, p] == k, p]
                    if len(own):
                        books[p, k] = [int(s) // len(own) for s in own.sum(0)]
    return codes, error, books


@pytest.mark.parametrize("spread", [3, 1 << 24])
def test_reassign_is_exact(spread):
    """Small whole numbers give many ties; large ones pass what floating point holds."""
    rng = np.random.default_rng(spread)
    rows, entries = rng.integers(-spread, spread + 1, (3000, 5)), rng.integers(-spread, spread + 1, (60, 5))
    entries[7] = entries[40]
    to = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (distances(rows, entries) == to).all()
    for start in (np.zeros(3000, np.int64), to.argmin(1), rng.integers(0, 60, 3000)):
        codes, best, _ = reassign(rows, entries, start)
        assert (codes == to.argmin(1)).all() and (best == to.min(1)).all()


def test_balls_save_distances():
    rng = np.random.default_rng(2)
    entries = rng.integers(-10_000, 10_000, (64, 4))
    at = rng.integers(0, 64, 5000)
    rows = entries[at] + rng.integers(-200, 200, (5000, 4))
    codes, _, done = reassign(rows, entries, at)
    assert done < 0.05 * 5000 * 63 and (codes == distances(rows, entries).argmin(1)).all()


def vectors():
    rng = np.random.default_rng(6)
    data = (rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 8))).astype(np.float32)
    data[100:160] = data[2]
    out = [(n, v.tolist(), n % 3 if n % 5 else None, "x", "y") for n, v in enumerate(data)]
    out[3] = (3, None, 1, "x", "y")
    out[4] = (4, [math.nan] + [0.5] * 7, 1, "x", "y")
    out[5] = (5, [None] + [0.5] * 7, 1, "x", "y")
    out[6] = (6, [math.inf] * 8, 1, "x", "y")
    out[7] = (7, [], 1, "x", "y")
    out[8] = (8, [1.0] * 4, 1, "x", "y")
    out[9] = (9, [1e30] * 8, 1, "x", "y")
    return [*out, out[60], (None, out[1][1], 1, "x", "y"), (0, out[90][1], 2, "x", "y")]


def whole(data):
    return [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label, *_ in data if i not in range(3, 10)]


@pytest.mark.parametrize("entries", [16, 256])
def test_codes_equal_plain_rounds(spark, entries):
    data = vectors()
    kept = whole(data)
    expected, errors, books = plain(kept, entries, rounds=2)
    coded, found = codes_and_books(spark.createDataFrame(data, SCHEMA).repartition(4), entries=entries, rounds=2)
    assert found.tolist() == books.tolist()

    def order(rows):
        return sorted(rows, key=repr)

    rows = [(r.vec_id, r.label, r.code, r.error) for r in coded.collect()]
    assert order(rows) == order((i, label, bytes(c.tolist()), e) for (i, label, _), c, e in zip(kept, expected, errors, strict=True))


def test_digest_columns(spark):
    data = vectors()
    kept = whole(data)
    codes, errors, books = plain(kept, 256)
    by_label = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
    rows = compressed(spark.createDataFrame(data, SCHEMA)).collect()
    expected = [(i, bytes(c.tolist()).hex(), e, by_label[label], digest) for (i, label, _), c, e in zip(kept, codes, errors, strict=True)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    assert len({(tuple(x)) for *_, x in kept}) > 50


def test_label_sums_by_either_join(spark):
    coded = spark.range(5000).selectExpr("id AS vec_id", "if(id % 3 = 0, NULL, if(id % 3 = 1, 7, id)) AS label", "id % 11 AS error")
    few, many = (sorted(map(repr, with_label_error(coded, at_once).collect())) for at_once in (1_000_000, 10))
    assert few == many and len(few) == 5000
    huge = spark.createDataFrame([(1, 1, 2**62), (2, 1, 2**62)], "vec_id long, label int, error long")
    assert [r.label_error for r in with_label_error(huge).collect()] == [None, None]


def test_empty_and_unusable(spark):
    for rows in ([], [(1, None, 1)], [(1, [], None)], [(None, [1.0] * 8, 1)], [(1, [1.0, 2.0, 3.0], 1)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert compressed(df).count() == 0
    one, books = codes_and_books(spark.createDataFrame([(5, [0.5] * 4)], "vec_id long, embedding array<float>"))
    assert one.collect() == [(5, None, bytearray(4), 0)] and books.shape == (4, 1, 1)
    assert books_digest(books) == hashlib.sha256(b"512,512,512,512").hexdigest()
