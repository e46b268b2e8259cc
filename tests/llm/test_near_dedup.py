"""Near-duplicate classes against all pairs, alignment against the plain table, and odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tabwright.llm import near_dedup
from tabwright.llm.near_dedup import Words, band_edits, near_duplicates, plain_edits, representatives, short_keys, similar, sketch

SCHEMA = "doc_id long, text string, node string, key int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def change(rng, words, number):
    words = list(words)
    for _ in range(number):
        at = rng.randrange(len(words) + 1)
        kind = rng.random()
        if kind < 0.6 and at < len(words):
            words[at] = f"new{rng.randrange(999)}"
        elif kind < 0.8 and len(words) > 1 and at < len(words):
            del words[at]
        else:
            words.insert(at, f"in{rng.randrange(999)}")
    return words


@pytest.mark.parametrize("rows", [1, 3, 16, 4096])
def test_band_equals_the_table(monkeypatch, rows):
    """With bands of many blocks too; beyond the limit any larger number may come out."""
    monkeypatch.setattr(near_dedup, "BAND_ROWS", rows)
    rng = random.Random(rows)
    for _ in range(400):
        a = [rng.randrange(9) for _ in range(rng.randrange(0, 40))]
        b = change(rng, a, rng.randrange(0, 12)) if rng.random() < 0.8 else [rng.randrange(9) for _ in range(rng.randrange(0, 40))]
        true = edits(a, b)
        for most in (0, 1, 3, 8, 50):
            if abs(len(a) - len(b)) <= most:
                found = band_edits(a, b, most)
                assert found == true if true <= most else found > most


def test_many_edits_cost_columns_not_diagonals(monkeypatch):
    """A text near the limit is settled by one pass over the columns of the band."""
    rng = random.Random(3)
    a = [rng.randrange(200) for _ in range(1500)]
    b = [n for n in change(rng, a, 240) if isinstance(n, int)]
    steps = []
    monkeypatch.setattr(near_dedup, "plain_edits", lambda a, b: steps.append(0) or len(a) + len(b))
    monkeypatch.setattr(near_dedup, "band_edits", lambda a, b, most: steps.append(most) or band_edits(a, b, most))
    a, b = (np.array(x, np.uint32) for x in (a, b))
    assert similar(a, b) and edits(a.tolist(), b.tolist()) <= 300
    assert len(steps) == 2


def test_pairs_leave_a_block_only_if_all_counts_allow_them():
    """As pairs they would carry both counts through a shuffle."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 90, rng.integers(40, 60)).astype(np.uint32) for _ in range(150)]
    counts = np.array([np.bincount(near_dedup.mixed(t.astype(np.uint64) * near_dedup.BASE + np.uint64(7)).view(np.int64) >> 20 & 511, minlength=512) for t in texts])
    signs = near_dedup.packed_counts(pa.array([near_dedup.signature(t) for t in texts], pa.binary()))
    none, words = np.zeros(150, bool), np.array([len(t) for t in texts])
    one, two = near_dedup.block_pairs(none, none, none, none, np.arange(150), words, signs, 0.4)
    most = np.floor(0.6 * np.maximum(words[:, None], words) + 1e-9)
    likely = (np.abs(words[:, None] - words) <= most) & (np.abs(counts[:, None] - counts).sum(2) <= 2 * most)
    assert 0 < len(one) < 150 * 149 // 4
    assert sorted(zip(one.tolist(), two.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(np.triu(likely, 1))), strict=True))


def test_a_node_of_many_pairs_is_sent_to_few_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_PAIRS", 100)
    pairs = spark.range(79_800).selectExpr("id DIV 400 AS a", "400 + id % 400 AS b")
    cells = near_dedup.in_cells(pairs, 79_800).cache()
    rows = cells.groupBy("cell").count().collect()
    assert sum(r["count"] for r in rows) == 79_800 and len(rows) > 400 and max(r["count"] for r in rows) < 1000
    sent = cells.selectExpr("cell", "a AS node").union(cells.selectExpr("cell", "b AS node")).distinct().groupBy("node").count()
    assert sent.agg({"count": "max"}).first()[0] <= 40  # as pairs up to 400 times


def test_alignment_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        b = change(rng, a, rng.randrange(0, 12)) if a and rng.random() < 0.8 else [rng.randrange(12) for _ in range(rng.randrange(0, 40))]
        numbers = {w: n for n, w in enumerate(dict.fromkeys([*a, *b]))}
        x, y = (np.array([numbers[w] for w in t], np.uint32) for t in (a, b))
        limit = 0.2 * max(len(a), len(b)) + 1e-9
        assert similar(x, y) == (edits(a, b) <= limit), (a, b)


def test_sketch_is_sensitive_to_order():
    words = np.arange(400, dtype=np.uint32)
    swapped = np.concatenate([words[200:], words[:200]])
    same = (sketch(words) == sketch(swapped)).mean()
    near = words.copy()
    near[100] = 9999
    assert (sketch(words) == sketch(near)).mean() > 0.8 > same + 0.2
    assert len(sketch(words[:4])) == 0 and len(sketch(np.zeros(3000, np.uint32))) == 24


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(500))
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(12):
        body = [word() for _ in range(rng.randrange(40, 160))] + (passage if group % 3 == 0 else [])
        for copy in range(rng.choice([1, 2, 5])):
            rows.append(" ".join(change(rng, body, copy * len(body) // 60)))
    rows += [" ".join(passage + [word() for _ in range(150)]) for _ in range(40)]  # one passage, other texts
    body = [word() for _ in range(100)]
    rows += [" ".join(change(rng, body, 2)) for _ in range(60)] + [" ".join(body)] * 30  # hot groups
    rows += ["Same  few\nwords", "same few words", "same few things", None, "", " \t", "one", "one"]
    rng.shuffle(rows)
    return [(n * 3, t, "x", 1) for n, t in enumerate(rows)]


def test_classes_equal_all_pairs(spark, corpus):
    texts = {i: (t or "").lower().split() for i, t, *_ in corpus}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = texts[i], texts[j]
            if a and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and root(i) != root(j) and len(set(a) & set(b)) > 0.5 * min(len(set(a)), len(set(b))):
                if (len(a) >= 5 or a == b) and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    out = near_duplicates(spark.createDataFrame(corpus, SCHEMA).repartition(4)).collect()
    assert len(out) == len(corpus)
    assert {r.doc_id: r.class_id for r in out} == {i: root(i) for i in ids}


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{n}" for n in range(50))
    rows = [(None, text, "x", 1), (4, text, "x", 1), (4, text, "x", 1), (9, text + " more", "x", 1), (None, "alone", "x", 1)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in out), key=str) == [(4, 4, 4), (4, 4, 4), (9, 4, 4), (None, 4, 4), (None, None, 1)]
    kept = representatives(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(4, text), (None, "alone")]


def test_empty_and_long(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    body = [f"w{n % 7000}x{n}" for n in range(30_000)]
    rows = [(1, " ".join(body), "x", 1), (2, " ".join(body[:10_000] + ["z"] + body[10_000:]), "x", 1), (3, "b " * 30_000, "x", 1)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id) for r in out) == [(1, 1), (2, 1), (3, 3)]


def test_pairs_in_the_bucket_of_a_large_class(spark):
    """One sketch, so one bucket: a class of many differing copies and other pairs that only meet there."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(900))
    passage = [word() for _ in range(100)]
    key = lambda words: sketch(Words().of(" ".join(words).encode()), sketches=1)[0]
    wanted = key(passage)
    large, texts = [word() for _ in range(60)], []
    while len(texts) < 300:
        texts.append(passage + change(rng, large, 3))
        if key(texts[-1]) != wanted:
            texts.pop()
    classes = [0] * 300
    while len(classes) < 340:
        own = [word() for _ in range(60)]
        two = [passage + own, passage + change(rng, own, 3)]
        if all(key(t) == wanted for t in two):
            classes += [len(classes)] * 2
            texts += two
    rows = [(n, " ".join(t), "x", 1) for n, t in enumerate(texts)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), sketches=1).collect()
    assert {r.doc_id: r.class_id for r in out} == dict(enumerate(classes))


def spread(words, number, even):
    """``number`` words replaced, evenly or anywhere."""
    words = list(words)
    rng = random.Random(f"{words[:3]}{number}")
    places = [(2 * n + 1) * len(words) // (2 * number) for n in range(number)] if even else rng.sample(range(len(words)), number)
    for at in places:
        words[at] = f"other{rng.randrange(10**9)}"
    return words


def test_pairs_at_the_limit(spark):
    """Pairs of 5 to 40 words and of 41 to 300 at similarities of 0.80 to 0.90, edits evenly spread and anywhere."""
    rng = random.Random(3)
    texts = []
    for size in [*range(5, 41), 41, 49, 50, 51, 60, 75, 100, 150, 200, 300]:
        for share in (0.8, 0.85, 0.9):
            number = max(1, int((1 - share) * size + 1e-9))
            for even in (True, False):
                body = [rng.choice("abcdefghijk") + str(rng.randrange(10**7)) for _ in range(size)]
                texts += [body, spread(body, number, even)]
    texts += [t for n in range(5, 41) for b in [[f"b{n}x{k}" for k in range(n)]] for t in (b, b[: n - n // 5])]  # words left out
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        assert edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    rows = [(n, " ".join(t), "x", 1) for n, t in enumerate(texts)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in out} == {n: n - n % 2 for n in range(len(texts))}


def test_short_texts_that_may_be_linked_share_a_key():
    rng = random.Random(11)
    for _ in range(4000):
        size = rng.randrange(1, 41)
        a = [rng.randrange(40) for _ in range(size)]
        b = [int(w[3:]) if isinstance(w, str) and w.startswith("new") else (50 + int(w[2:]) if isinstance(w, str) else w) for w in change(rng, a, rng.randrange(0, size // 5 + 2))]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        for similarity in (0.8, 0.7):
            if max(len(a), len(b)) <= 50 and len(a) and a != b and similar(x, y, similarity):
                assert short_keys(x, similarity) & short_keys(y, similarity), (a, b, similarity)


def test_many_texts_that_are_almost_near(spark):
    """Texts of one long passage that differ in a fifth of the words and more, with a few copies among them."""
    rng = random.Random(17)
    word = lambda: rng.choice("abcdefghijk") + str(rng.randrange(10**6))
    passage = [word() for _ in range(120)]
    texts, classes = [], []
    for n in range(150):
        own = [word() for _ in range(35)]
        for text in [passage + own] + [passage + spread(own, 2, True)] * (n % 10 == 0):
            classes.append(len(classes) if text[-35:] == own else len(classes) - 1)
            texts.append(" ".join(text))
    rows = [(n, t, "x", 1) for n, t in enumerate(texts)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in out} == dict(enumerate(classes))


def test_quick_edits_are_never_too_few():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(60) for _ in range(rng.randrange(0, 50))]
        b = change(rng, a, rng.randrange(0, 9)) if a and rng.random() < 0.8 else [rng.randrange(60) for _ in range(rng.randrange(0, 50))]
        numbers = {w: n for n, w in enumerate(dict.fromkeys([*a, *b]))}
        x, y = (np.array([numbers[w] for w in t], np.uint32) for t in (a, b))
        assert max(len(a), len(b)) >= plain_edits(x, y) >= edits(a, b)
    words = np.arange(100, dtype=np.uint32)
    assert plain_edits(words, words) == 0 and plain_edits(words, np.delete(words, [5, 50])) == 2 and plain_edits(words, np.insert(words, 7, 999)) == 1


@pytest.mark.parametrize("block", [16, 4096])
def test_buckets_of_any_size_are_settled_alike(spark, monkeypatch, block):
    """Unrelated texts around one phrase, with a few near copies among them."""
    from tabwright.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(12)
    phrase, texts = "the very same words".split(), []
    for n in range(90):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 30))]
        texts.append([*own[:2], *phrase, *own[2:]])
        if n % 9 == 0:
            copy = list(texts[-1])
            copy[-1] = "other"
            texts.append(copy)
    rng.shuffle(texts)
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if edits(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert found == dict(enumerate(root)) and len(set(root)) < len(texts)


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c", "mine", 5), (2, "x y z", "too", 6), (3, "a b c", "gone", 7)], "doc_id long, text string, mark string, text_mark int")
    assert sorted(map(tuple, representatives(df).collect())) == [(1, "a b c", "mine", 5), (2, "x y z", "too", 6)]
