"""Language and toxicity on held-out documents, the kernel against its definition, and odd input."""

import itertools
import zlib

import numpy as np
import pytest

from tabwright.llm.languages import identify
from tabwright.llm.queries import QUERIES
from tabwright.llm.toxicity import DECAY, LENGTH, Landmarks, kernel, letters, score_toxicity, shared

SCHEMA = "doc_id long, text string, lang string, score string, toxic string"
DATA = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def by_definition(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), LENGTH):
        for b in itertools.combinations(range(len(t)), LENGTH):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@pytest.mark.parametrize(("s", "t"), [("idiot", "idiot"), ("idxiot", "idiot"), ("banana", "bandana"), ("abc", "abcd"), ("xyzw", "abcd")])
def test_kernel_and_shared_letters(s, t):
    value = kernel(letters([s], 8), letters([t], 9))[0]
    assert value == pytest.approx(by_definition(s, t), rel=1e-4)
    alphabet = np.union1d(letters([s], 8), letters([t], 9))
    places = np.searchsorted(alphabet, letters([s], 8).T)
    assert (shared(places, alphabet, t)[0] >= LENGTH) == (value > 0)


def test_gaps_and_pushed_in_letters_keep_kernels_high():
    marks = Landmarks(["^idiot", "^table"])
    rows = marks.features(["idiot", "idxiot", "idioot", "window", ""])
    assert rows[0, 0] == pytest.approx(1, abs=1e-4) and rows[1, 0] > 0.3 and rows[2, 0] > 0.3
    assert rows[3].max() < 0.1 and rows[4].max() == 0


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op5_language_id"](spark, DATA).collect()
    assert len(out) == len(docs) and all(r.held_out == held(r.doc_id) for r in out)
    scored = [r.lang_pred == docs[r.doc_id] for r in out if r.held_out]
    assert sum(scored) / len(scored) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_languages_of_odd_texts(spark):
    plain = [(n, "the cat and the dog " * 3 if n % 2 else "le chat et la souris " * 3, "en" if n % 2 else "fr", "x", "y") for n in range(60)]
    odd = [(100, None, "en", "x", "y"), (101, "", "en", "x", "y"), (102, "12 !", "fr", "x", "y"), (None, "the dog " * 50_000, None, "x", "y"), plain[3]]
    out = identify(spark.createDataFrame(plain + odd, SCHEMA).repartition(4)).collect()
    assert len(out) == 65
    assert {r.lang_pred for r in out if r.doc_id in (100, 101, 102)} == {"und"}
    assert [r.lang_pred for r in out if r.doc_id is None] == ["en"]
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = identify(spark.createDataFrame([(1, "the cat", None, "x", "y")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = QUERIES["op8_toxicity"](spark, DATA).collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    scored = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    toxic = [p for p, t in scored if t]
    clean = [p for p, t in scored if not t]
    assert np.mean(toxic) > 0.5 and np.mean(clean) < 0.05


def test_toxicity_of_odd_texts(spark):
    rng = np.random.default_rng(1)
    words = ["house", "garden", "window", "river", "mountain", "paper", "yellow"]
    docs, labels = [], []
    for n in range(200):
        text = [str(w) for w in rng.choice(words, 30)]
        if n % 4 == 0:
            text[7] = text[19] = "blockhead"
        docs.append((n, " ".join(text) + ".", "en", "x", "y"))
        labels.append((n, 1, int(n % 4 == 0), "z"))
    extra = [(1000, None), (1001, ""), (1002, "you block-head. river"), (1003, "a b l o c k h e a d now"), (1004, "blocxkhead river"), (1005, "river paper " * 30_000), (None, "blockhead")]
    frame = spark.createDataFrame(docs + [(*e, "en", "x", "y") for e in extra] + [docs[0]], SCHEMA).repartition(3)
    marked = spark.createDataFrame([*labels, (None, 1, 1, "z"), (3, 0, None, "z"), (77777, 0, 1, "z")], "doc_id long, quality int, toxic int, text string")
    rows = score_toxicity(frame, marked).collect()
    found = {r.doc_id: r.predicted for r in rows}
    assert len(rows) == len(docs) + len(extra) + 1
    assert all(found[n] == int(n % 4 == 0) for n in range(200))
    assert [found[n] for n in (1000, 1001, 1005)] == [0, 0, 0]
    assert found[1002] == 1 and found[1004] == 1 and found[None] == 1
    none = score_toxicity(frame, marked.where("toxic = 0")).collect()
    assert len(none) == len(rows) and {r.predicted for r in none} == {0}
    assert score_toxicity(frame.limit(0), marked).count() == 0
