"""SimHash components against a plain version, at every depth of dealing."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabwright.llm import fingerprints
from tabwright.llm.fingerprints import _masks_by_level, counted_pairs, fingerprint, links_between, next_masks, simhash_components


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode()))
    shingles = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, bits=3):
    """Smallest id reachable from each place; None is larger than any id."""
    root = list(range(len(prints)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, own in enumerate(ids):
        least[find(n)] = min(least.get(find(n), float("inf")), float("inf") if own is None else own)
    return [None if least[find(n)] == float("inf") else least[find(n)] for n in range(len(prints))]


def texts():
    rng = random.Random(5)
    words = [f"w{n}" for n in range(300)] + ["Ärger", "ÉTÉ", "ÀB"]
    out = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            changed = list(base)
            changed[rng.randrange(len(changed))] = rng.choice(words)
            out.append("\t".join(changed).upper() if rng.random() < 0.5 else "\n ".join(changed))
    return [*out, None, "", " \t\r\n", "one", "One two", "ONE\x0btwo", "a b c", "a b c", "\xa0 \x1f", "x " * 2000]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_prints_equal_a_plain_version(monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    for text in texts():
        found, count = fingerprint((text or "").encode())
        assert found == plain_print(text) and count == len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def test_shingle_hash_is_sparks(spark):
    row = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] % (1 << 64) == fingerprint(b"A b C")[0]


def test_components_equal_all_pairs(spark):
    rows = [(n, t, f"mark {n}", n) for n, t in enumerate(texts())]
    rows += [(None, rows[0][1], "no id", 0), (None, "nobody else says this", "alone", 1), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id long").repartition(3)
    out = simhash_components(df).collect()
    prints = [plain_print(t) for _, t, *_ in rows]
    expected = plain_components(prints, [r[0] for r in rows])
    counted = [len((t or "").encode().split()) for _, t, *_ in rows]

    def order(row):
        return (row[0] is None, row[0] or 0, row[1], row[3])

    assert sorted(map(tuple, out), key=order) == sorted(((r[0], f"{p:016x}", c, n) for r, p, c, n in zip(rows, prints, expected, counted, strict=True)), key=order)
    assert len(set(expected)) < len(set(prints))  # there are links between different prints


def test_every_close_pair_meets():
    for common in [(), *(m for level in _masks_by_level(3) for m in level)]:
        after = next_masks(common)
        left = [p for p in range(8) if p not in common]
        assert bool(after) == (len(left) >= 4)
        for a in left:
            for b in left:
                for c in left:
                    assert not after or any(not {a, b, c} & (set(m) - set(common)) for m in after)


def test_tally_counts_shared_bytes():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 4, (200, 8)).astype(np.uint8).view(">u8").reshape(-1).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, 200))
    octets = prints.astype(">u8").view(np.uint8).reshape(-1, 8)
    pairs = {(a, b) for b in range(200) for a in range(b) if group[a] == group[b] and (octets[a] == octets[b]).sum() >= 5}
    assert set(zip(*map(np.ndarray.tolist, counted_pairs(group, prints, 5)), strict=True)) == pairs and pairs


@pytest.mark.parametrize("room", [1024, 20, 2])
@pytest.mark.parametrize("bits", [3, 1, 0])
def test_crowded_fingerprints_lose_no_link(spark, room, bits):
    """Fingerprints that share most bytes, in chains and clusters, dealt to every depth."""
    rng = random.Random(11)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            at ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))) & (2**64 - 1)
            prints.add(at)
    low = rng.getrandbits(64) & ~0xFFFFFF  # five bytes in common
    prints |= {low | rng.getrandbits(24) for _ in range(120)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links_between(df, bits, room).collect()]
    place = {p: n for n, p in enumerate(prints)}
    root = fingerprints.forest(*(np.array([place[x[end]] for x in links], np.int64) for end in (0, 1)), len(prints))
    assert root.tolist() == plain_components(prints, range(len(prints)), bits)


def test_forest_grows_with_rows_not_pairs(spark):
    """1,000 fingerprints within two bits of each other give few links, and many copies of a text one node."""
    df = spark.createDataFrame([((1 << a) | (1 << b),) for a in range(45) for b in range(a)], "print long")
    assert links_between(df).count() <= 4 * 4 * df.count()
    copies = spark.range(3000).selectExpr("id AS doc_id", "'the same words again' AS text")
    out = simhash_components(copies)
    assert out.count() == 3000 and out.select("component_id").distinct().collect() == [(0,)]


def test_no_documents(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
