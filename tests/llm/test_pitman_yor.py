"""Scores: exact counts, a proper distribution, better than the base on held-out texts, odd input."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabwright.llm.pitman_yor import END, draw_tables, grams, letter_model, lgamma, predictive, score_texts, stirling
from tabwright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, block int, score string"
FIELDS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def plain(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, words in tokens if not held(i) for w in words)
    total, kinds = sum(counts.values()), len(counts)
    base = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(i, held(i), len(ws), sum(w in counts for w in ws), total, sum(map(base, ws))) for i, ws in tokens]


def same(out, expected):
    key = lambda r: str(tuple(r[:5]))
    out, expected = sorted((tuple(r[f] for f in FIELDS) for r in out), key=key), sorted(expected, key=key)
    assert [r[:5] for r in out] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in out], [r[5] for r in expected], rtol=1e-9)


def test_small_documents(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    out = QUERIES["op3_lm_score"](spark, small_dir).collect()
    same(out, plain(rows))
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert all(r.score < 0 and r.spelled_score <= r.score + 1e-6 for r in out)


def test_odd_input(spark):
    rows = [(n, f"Common words\there {n % 7}", 1, "x") for n in range(40)]
    rows += [(50, None, 1, "x"), (51, "", 1, "x"), (None, "no Id", 1, "x"), (52, "É\x1cx \x85", 1, "x"), (53, "long" * 50_000, 1, "x"), rows[3], rows[3]]
    out = score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    same(out, plain(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = score_texts(spark.createDataFrame([(held, "a b", 1, "x")], SCHEMA)).collect()
    assert out[0].train_tokens == 0 and out[0].base_score == 0 and math.isfinite(out[0].spelled_score)


def test_grams_spell_words():
    codes, begins = grams([END, b"ab", b"abcde"])
    assert [int(c).to_bytes(4, "big") for c in codes] == [b"    ", b"   a", b"  ab", b" ab ", b"   a", b"  ab", b" abc", b"abcd", b"bcde", b"cde "]
    assert begins.tolist() == [0, 1, 4]


def test_letters_sum_to_one():
    rng = np.random.default_rng(1)
    seen = np.unique(rng.integers(97, 101, (300, 4)).astype(np.uint32) @ np.array([1 << 24, 1 << 16, 0, 1], np.uint32)) | np.uint32(ord("e") << 8)
    customers = rng.integers(1, 200, len(seen))
    context = int(seen[0]) >> 8 << 8
    unseen = (context | np.arange(256)).astype(np.uint32)
    codes = np.unique(np.concatenate([seen, unseen]))
    counts = np.zeros(len(codes), np.int64)
    counts[np.searchsorted(codes, seen)] = customers
    logs, root = letter_model(codes, counts, np.full(256, -np.log(256)), rng)
    assert np.exp(logs[np.searchsorted(codes, unseen)]).sum() == pytest.approx(1)
    assert root.sum() >= 4


def test_tables_follow_their_conditional():
    discount, strength, count, others, base = 0.5, 1.0, 5, 3.0, 0.2
    numbers = stirling(discount)
    t = np.arange(1, count + 1)
    rise = np.array([np.prod([strength + discount * (others + i) for i in range(k)]) for k in t])
    exact = np.exp(numbers[count, 1 : count + 1]) * rise * base**t
    drawn = draw_tables(np.random.default_rng(0), np.full(40_000, count), np.full(40_000, others), np.full(40_000, math.log(base)), discount, strength, numbers)
    assert np.allclose(np.bincount(drawn, minlength=count + 1)[1:] / 40_000, exact / exact.sum(), atol=0.01)
    many = draw_tables(np.random.default_rng(0), np.full(50, 100_000), np.zeros(50), np.full(50, math.log(0.01)), discount, strength, numbers)
    assert (many >= 1).all() and (many <= 100_000).all()


def test_numbers():
    assert np.allclose(lgamma(np.array([0.5, 1, 7.3, 1e6])), [math.lgamma(x) for x in (0.5, 1, 7.3, 1e6)])
    log = predictive(np.array([3, 0]), np.array([1, 0]), 3, 1, np.log([0.4, 0.6]), 0.5, 1.0)
    assert np.exp(log).sum() == pytest.approx(1)


def test_score_depends_on_the_word_before(spark):
    learnt = [(n, "red fish swim past green birds", 1, "x") for n in range(30) if zlib.crc32(str(n).encode()) % 10]
    held = [n for n in range(30, 200) if zlib.crc32(str(n).encode()) % 10 == 0][:2]
    rows = learnt + [(held[0], "red fish swim past green birds", 1, "x"), (held[1], "birds past red green swim fish", 1, "x")]
    out = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert out[held[0]].base_score == pytest.approx(out[held[1]].base_score)
    assert out[held[0]].score > out[held[1]].score + 3
