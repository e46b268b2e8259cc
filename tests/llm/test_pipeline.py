"""The pipeline's stages against plain versions on the smallest documents, and on odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tabwright.llm.queries import table, vocabulary
from tabwright.llm.toxicity import score_toxicity
from test_near_dedup import edits
from test_suffix_dedup import expected as without_repeats


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    docs, out = table(spark, small_dir, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        stage(spark, docs, small_dir).write.parquet(path)
        if name != "bpe":
            assert spark.read.parquet(path).schema == docs.schema
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_toxic_documents_go(spark, small_dir, stages):
    docs = table(spark, small_dir, "documents")
    toxic = {r.doc_id for r in score_toxicity(docs, table(spark, small_dir, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in stages["toxicity"]} == {r.doc_id for r in stages["documents"]} - toxic


def test_one_of_each_class_stays(stages):
    rows = sorted(stages["toxicity"])
    words = [r.text.lower().split() for r in rows]
    gone = {r.doc_id for r in rows} - {r.doc_id for r in stages["near_dedup"]}
    for n, r in enumerate(rows):
        near = any(
            abs(len(words[n]) - len(words[k])) <= 0.2 * max(len(words[n]), len(words[k]))
            and len(set(words[n]) & set(words[k])) > 0.5 * len(set(words[n]))
            and edits(words[n], words[k]) <= 0.2 * max(len(words[n]), len(words[k]))
            for k in range(n)
        )
        assert near == (r.doc_id in gone), r.doc_id


def test_repeats_are_cut(stages):
    rows = [(r.doc_id, r.text) for r in stages["near_dedup"]]
    plain = {r[0]: r for r in without_repeats(rows)}
    kept = {r.doc_id: r for r in stages["suffix_dedup"]}
    assert set(kept) == {i for i, r in plain.items() if r[2] < r[1] or r[1] == 0}
    source = {r.doc_id: r for r in stages["near_dedup"]}
    for i, r in kept.items():
        assert (r.lang, r.source) == (source[i].lang, source[i].source) and r.n_chars == len(r.text)
        if r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == plain[i][4]


def test_mix_and_tokens(stages):
    before, after = {r.doc_id: r for r in stages["suffix_dedup"]}, Counter(r.doc_id for r in stages["mixing"])
    assert set(after) <= set(before) and max(after.values()) <= 3
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert Counter(r.doc_id for r in stages["bpe"]) == after
    for r in stages["bpe"]:
        ids = np.array(library.encode(before[r.doc_id].text, add_special_tokens=False).ids, "<u4")
        assert bytes(r.ids) == ids.tobytes() and r.n_tokens == len(ids)


def test_odd_rows_pass_every_stage(spark, small_dir):
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(None, None, None, None, None), (1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text + " end", "en", None, 3), (3, "", "en", "a", 0), (None, "x", None, "b", 1)]
    schema = table(spark, small_dir, "documents").schema
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small_dir)
        assert all(r.decoded_sha256 for r in docs.collect())


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
