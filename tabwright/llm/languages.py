"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of byte pairs and triples, lower-cased, with everything in ASCII but letters as space.
Document frequencies cover all training texts. Centroids of each language are clustered from a bounded sample of
its training texts; a prediction takes the language of the centroid with the highest cosine. Texts farther from it
than nearly all sampled texts of that language are marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import text_bytes

FEATURES = 1 << 13
CENTROIDS = 4
SAMPLE = 1000
MOST_LANGUAGES = 1000
SHARPNESS = 30.0
REJECTED = 0.002
LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def fold(column: str, folds: int):
    """Remainder of the CRC-32 of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed byte pair and triple occurs."""
    data = np.frombuffer(b" " + text.lower().encode().translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])]
    pairs = data[:-1] * np.uint32(0x1F35) + data[1:] * np.uint32(0x9E3779B1)
    triples = pairs[:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
    codes = np.concatenate([pairs, triples])
    return np.bincount((codes ^ codes >> np.uint32(15)) % np.uint32(FEATURES), minlength=FEATURES)


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(rows).astype(np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", weighed, weighed))
    return weighed / np.maximum(norm, 1e-12)[:, None]


def _frequencies(batches):
    seen, number = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in text_bytes(batch.column(0)):
            seen += counts(text.decode()) > 0
            number += 1
    if number:
        part = TaskContext.get().partitionId() % 32
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([number]), "seen": pa.array([seen.tobytes()], pa.binary())})


def _add_up(key, table):
    seen = sum(np.frombuffer(s, np.int64) for s in table.column("seen").to_pylist())
    return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "seen": pa.array([seen.tobytes()], pa.binary())})


def _clusterer(idf: np.ndarray, number: int):
    def cluster(key, table):
        rows = weigh(np.stack([counts(t.decode()).astype(np.float32) for t in sorted(text_bytes(table.column("text")))]), idf)
        rng = np.random.default_rng(7)
        centres = rows[rng.choice(len(rows), 1)]
        while len(centres) < min(number, len(rows)):  # the row worst served becomes the next start
            centres = np.concatenate([centres, rows[[(rows @ centres.T).max(1).argmin()]]])
        for _ in range(10):
            nearest = (rows @ centres.T).argmax(1)
            sums = np.stack([rows[nearest == k].sum(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-12)[:, None]
        limit = float(np.quantile((rows @ centres.T).max(1), REJECTED))
        data = [c.astype(np.float32).tobytes() for c in centres]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(data)), "centre": pa.array(data, pa.binary()), "least": pa.array([limit] * len(data))})

    return cluster


def _predictor(idf, names, centres, limits):
    first = np.array([n for n, name in enumerate(names) if not n or names[n - 1] != name])

    def predict(batches):
        for batch in batches:
            ids, held, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            langs, scores, far = [], [], []
            for at in range(0, batch.num_rows, 256):
                part = [t.decode() for t in text_bytes(texts.slice(at, 256))]
                lettered = [has_letter(t) and bool(names) for t in part]
                chosen = {}
                if any(lettered):
                    rows = weigh(np.stack([counts(t) for t, ok in zip(part, lettered, strict=True) if ok]), idf)
                    best = np.maximum.reduceat(rows @ centres.T, first, axis=1)
                    share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
                    top = best.argmax(1)
                    for n, row, k in zip(np.flatnonzero(lettered).tolist(), range(len(top)), top.tolist(), strict=True):
                        chosen[n] = (names[first[k]], float(1 / share[row].sum()), bool(best[row, k] < limits[first[k]]))
                for n in range(len(part)):
                    lang, score, reject = chosen.get(n, ("und", 0.0, True))
                    langs.append(lang)
                    scores.append(score)
                    far.append(reject)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "held_out": held, "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "rejected": pa.array(far, pa.bool_())}
            )

    return predict


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score, rejected.

    Learns from text and ``lang`` of rows whose fold isn't ``held_out``, whose lang isn't null and whose text has a
    letter: frequencies from all of them, centroids from about ``sample`` texts a language, chosen by a hash.
    ``lang_pred`` is a learned value, or ``und`` where the text is null or has no letter, or nothing was learned.
    ``score`` (0 to 1) is the softmax of the languages' best cosines, 0 for ``und``. ``rejected`` marks texts too
    far from every centroid, and ``und``. Repeated rows are predicted alike; other columns are ignored.
    """
    spark = docs.sparkSession
    columns = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), (fold("doc_id", folds) == held_out).alias("held_out"))
    train = columns.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names, centres, limits, idf = [], np.zeros((0, FEATURES), np.float32), [], np.ones(FEATURES, np.float32)
    if sizes:
        parts = train.select("text").mapInArrow(_frequencies, "part int, n long, seen binary")
        parts = parts.groupBy("part").applyInArrow(_add_up, "n long, seen binary").collect()
        total = sum(p.n for p in parts)
        seen = sum(np.frombuffer(p.seen, np.int64) for p in parts)
        idf = (np.log((1 + total) / (1 + seen)) + 0.1).astype(np.float32)
        rates = spark.createDataFrame([(k, min(1.0, sample / v)) for k, v in sizes.items()], "lang string, rate double")
        draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
        chosen = train.join(F.broadcast(rates), "lang").where(draw).select("lang", "text")
        found = chosen.groupBy("lang").applyInArrow(_clusterer(idf, centroids), "lang string, centre binary, least double").orderBy("lang").collect()
        names, limits = [r.lang for r in found], [r.least for r in found]
        if found:
            centres = np.stack([np.frombuffer(r.centre, np.float32) for r in found])
    kinds = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return columns.select("doc_id", "held_out", "text").mapInArrow(_predictor(idf, names, centres, limits), kinds)
