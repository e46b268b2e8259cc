"""What a worker holds at once, and how many rows the steps between nodes of large groups make."""

import random
import weakref

import numpy as np
import pyarrow as pa

from tabwright.llm import near_dedup, toxicity
from tabwright.llm.blocks import kept


class Large:
    """Something that a stage keeps."""


def test_a_stage_lets_go_what_another_has_kept():
    first = weakref.ref(kept("test one", 1, Large))
    assert kept("test one", 1, Large) is first()
    second = weakref.ref(kept("test two", 1, Large))
    assert first() is None and second() is not None
    assert kept("test two", 2, Large) is not second() and second() is None


def test_toxicity_splits_few_texts_at_once(monkeypatch):
    """Whatever the number of rows in a batch; the rows and their order stay."""
    sizes = []
    plain = toxicity.Sentences.of
    monkeypatch.setattr(toxicity.Sentences, "of", lambda self, texts: sizes.append(sum(map(len, texts))) or plain(self, texts))
    texts = [f"word{n} idiot. " * 1000 for n in range(400)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(402), pa.int64()), "text": pa.array(texts, pa.string())})
    model = (["^idiot", "^plain"], np.array([-1.0, 0.0]), 0.0, np.array([-5.0, 1.0, 0.0, 0.0]))
    out = list(toxicity._rejecter(model, 1)([batch]))
    assert max(sizes) <= (1 << 20) + 15_000 and max(b.nbytes for b in out) < 2 << 20
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([batch]))


def test_words_are_learned_anew_when_many_are_known(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 50)
    words, rng = [f"w{n}idiot" for n in range(400)], random.Random(2)
    texts = [" ".join(rng.choices(words, k=30)) + "." for _ in range(60)]
    marks = toxicity.Landmarks(["^idiot", "^plain"])
    few, every = toxicity.Sentences(marks), toxicity.Sentences(marks)
    found = np.concatenate([few.of([t])[0] for t in texts])
    assert (found == every.of(texts)[0]).all() and len(few.number) <= 80


def test_long_texts_of_common_words_are_no_pairs():
    """Hundreds of words fill the slots that blocks compare, so that counts in more slots decide."""
    rng = np.random.default_rng(6)
    texts = [np.concatenate([np.arange(400), rng.integers(1000, 10**6, 400)]).astype(np.uint32) for _ in range(40)]
    texts += [np.where(np.arange(800) % 8 == 0, 5, t) for t in texts[:3]]
    signs = [near_dedup.squeeze(near_dedup.signature(t, near_dedup.FINE)) for t in texts]
    n = len(texts)
    rows = {"block": np.zeros(n, np.int64), "tag": np.zeros(n, np.int64), "node": np.arange(n), "words": np.full(n, 800, np.int32), "component": np.arange(n)}
    batch = pa.RecordBatch.from_pydict(rows | {"signature": pa.array(signs, pa.binary())})
    pairs = {tuple(sorted(map(int, p))) for out in near_dedup._pairer(0.8)([batch]) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    linked = {(a, b) for a in range(n) for b in range(a + 1, n) if near_dedup.similar(texts[a], texts[b].astype(np.uint32))}
    assert linked == {(0, 40), (1, 41), (2, 42)} and linked <= pairs and len(pairs) < 10


def test_counts_never_hide_a_link():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.randrange(1, 400)
        a = [rng.randrange(500) for _ in range(size)]
        b = list(a)
        for _ in range(rng.randrange(size // 5 + 2)):
            at, kind = rng.randrange(len(b) + 1), rng.random()
            if kind < 0.4 and at < len(b):
                b[at] = rng.randrange(1000, 2000)
            elif kind < 0.7 and len(b) > 1 and at < len(b):
                del b[at]
            else:
                b.insert(at, rng.randrange(1000, 2000))
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        fine = near_dedup.fine_counts(pa.array([near_dedup.squeeze(near_dedup.signature(t, near_dedup.FINE)) for t in (x, y)], pa.binary()))
        coarse = near_dedup.packed_counts(pa.array([near_dedup.signature(t) for t in (x, y)], pa.binary()))
        assert (near_dedup.coarse(fine) == coarse).all()
        if near_dedup.similar(x, y):
            assert near_dedup.fine_agreeing(fine, fine, np.array([0]), np.array([1]), np.array([len(x)]), np.array([len(y)]), 0.8)[0]


def test_a_leader_is_sent_once_for_many_pairs(spark):
    """Stars of one node and of 3,000; a node of a star is sent once."""
    stars = spark.range(3000).selectExpr("0L AS a", "10000 + id AS b").union(spark.range(3000).selectExpr("20000 + id AS a", "30000 + id AS b"))
    cells = near_dedup.by_leaders(stars, 6000).cache()
    assert sorted(map(tuple, cells.select("a", "b").collect())) == sorted(map(tuple, stars.collect()))
    counts = cells.groupBy("cell").count().collect()
    assert len(counts) > 12 and max(r["count"] for r in counts) < 2000
    sent = cells.selectExpr("cell", "a AS node").union(cells.selectExpr("cell", "b AS node")).distinct()
    assert sent.count() <= 9000 + 12 + 1 and sent.where("node = 0").count() <= 12
