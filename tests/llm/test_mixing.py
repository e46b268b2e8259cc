"""The mix against a plain computation, and its promises."""

import math
import re
from collections import defaultdict

from tabwright.llm.mixing import draw, mix

SCHEMA = "doc_id long, text string, source string, size int, prefix string"


def rows(count=900):
    out = []
    for n in range(count):
        source = ["b", "a", "hot", "hot", "hot", "é", "Z", None, ""][n % 9]
        words = (n * 37) % 60 + (2000 if n % 211 == 0 else 0)
        out.append((n, None if n % 50 == 3 else " w\tx" * words, source, 1, "x"))
    return [*out, out[10], (None, "a b c", "a", 1, "x"), (7, "", "empty", 1, "x")]


def targets(data):
    sizes = defaultdict(int)
    for _, text, source, *_ in data:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(ordered)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in ordered if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return sizes, {s: capped.get(s, level * weight[s]) for s in ordered}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    data = rows()
    sizes, expected = targets(data)
    out = mix(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert len(out) == len(data)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, expected[r.source], rel_tol=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, target in expected.items():
        largest = max((r.size for r in out if r.source == source), default=0)
        assert abs(taken[source] - target) <= 2 * largest + 1e-6 * target
    again = mix(spark.createDataFrame(data, SCHEMA).repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_draw_repeats_rows(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    drawn = draw(df)
    assert drawn.columns == df.columns
    copies = {}
    for r in mix(df).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    counts = defaultdict(int)
    for r in drawn.collect():
        counts[r.doc_id] += 1
    assert counts == {i: c for i, c in copies.items() if c}


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mix(spark.createDataFrame([(1, " ", "a", 1, "x"), (2, None, None, 1, "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_columns_of_any_name_are_kept(spark):
    data = [(n, "a b c " * (n % 7), "s", f"own {n}", "mine", n) for n in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mix_id string, MIX_count string, mix_copy int")
    out = draw(df).collect()
    assert out and all((r.mix_id, r.MIX_count, r.mix_copy) == (f"own {r.doc_id}", "mine", r.doc_id) for r in out)


def test_a_hot_source_is_spread(spark):
    """One source of equal documents, without broadcasts by estimate: no partition holds more than a few shares."""
    from pyspark.sql import functions as F

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.range(20_000).selectExpr("id AS doc_id", "'the same words' AS text", "'one' AS source")
        held = [r["n"] for r in mix(docs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(held) == 20_000 and len(held) == 16 and max(held) < 4 * 20_000 / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_sources_by_salted_lookups(spark, monkeypatch):
    from tabwright.llm import mixing

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    plain = sorted(map(repr, mix(df).collect()))
    monkeypatch.setattr(mixing, "LOOKUP_ROWS", 2)
    assert sorted(map(repr, mix(df).collect())) == plain


def test_very_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "", "a"), (3, None, "b"), (4, "w " * 10, "b")], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mix(docs).collect()}
    assert out[1].size == 300_000 and out[2].size == out[3].size == 0 and {r.doc_id for r in out.values()} == {1, 2, 3, 4}
