"""Repeats removed by the suffix sort against a dictionary of all windows."""

import hashlib
import random

import pytest

from tabwright.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, block int, ids string"


def expected(rows, depth=50):
    first = {}
    texts = [(i if i is not None else 2**63 - 1, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        for at in range(len(t) - depth + 1):
            w = t[at : at + depth]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, t), row in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for at in range(len(t) - depth + 1):
            if first[t[at : at + depth]] < i:
                gone[at : at + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, depth=50):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")
    return sorted((tuple(r) for r in remove_repeats(df, depth).drop("kept", "extra").collect()), key=str)


def wrap(pairs):
    return [(i, t, "en", 1, "x") for i, t in pairs]


def test_overlaps_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)]
    pairs = [(n, "".join(rng.choice([rng.choice(passages), word() * 3, "a" * 70]) for _ in range(8))) for n in range(60)]
    pairs += [(60, None), (61, ""), (62, "short"), (63, "x" * 49), (64, "x" * 50), (65, "x" * 51), (65, "x" * 51), (None, "x" * 60), (None, "y" * 60), (None, "y" * 60)]
    pairs += [(66 + n, passages[0] + str(n)) for n in range(30)] + [(5, passages[1])]
    rng.shuffle(pairs)
    assert found(spark, wrap(pairs)) == expected(wrap(pairs))
    assert found(spark, wrap(pairs[:60]), 24) == expected(wrap(pairs[:60]), 24)


def test_long_text_over_many_slices(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    pairs = [(1, body), (2, body[70_000:140_000] + "!" + body[:100]), (3, "z" * 66_000), (4, "z" * 51)]
    assert found(spark, wrap(pairs)) == expected(wrap(pairs))


def test_kept_text_and_carried_columns(spark):
    rows = [(1, "é" * 40 + "one", "fr", 1, "x"), (2, "a" + "é" * 40 + " two", None, 2, 'q"\n'), (2, "a" + "é" * 40 + " two", None, 2, 'q"\n'), (None, None, "de", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = remove_repeats(df, with_text=True, carry=["lang", "block", "ids"]).selectExpr("doc_id", "kept", "from_json(extra, 'lang string, block int, ids string') c").select("doc_id", "kept", "c.*")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "é" * 40 + "one", "fr", 1, "x"), (2, "a two", None, 2, 'q"\n'), (2, "a two", None, 2, 'q"\n'), (None, "", "de", None, "x")], key=str
    )


def test_empty_table(spark):
    assert found(spark, []) == []


def test_depth_is_checked(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([], SCHEMA), 10)


def test_query_on_the_small_documents(spark, small_dir):
    from tabwright.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, small_dir).collect()), key=str)
    assert out == expected(rows)
    assert any(r[2] for r in out)
