"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums the subsequences of ``LENGTH`` letters they share, each weighted by ``DECAY`` to the
power of its spans, and is normalised. Letters pushed into an insult, or gaps in it, lower the kernel with the word
it hides, but don't end it. A sentence meets a landmark through its nearest word. Landmarks are words and beginnings
of words of labelled sentences, chosen so that together they reach the toxic documents, and some ordinary words.
The machine is trained on sentences: as labels are given for documents, each document is represented by its most
toxic sentence so far, round after round. A document's score is a logistic curve of its most toxic sentence and of
how many of its sentences are toxic.

A word that shares no ordered ``LENGTH`` letters with a landmark has kernel zero exactly. That is found for all
words at once with bit-parallel subsequence lengths, and only the other pairs are computed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import kept, parts_of, text_bytes, written
from tabwright.llm.languages import fold

LENGTH = 4
DECAY = 0.7
LANDMARKS = 40
ORDINARY = 8
CANDIDATES = 600
SAMPLE = 1500
ROUNDS = 4
LONGEST = 24
PAIRS = 2_000  # word pairs at once: their cells stay in the processor's cache
CACHE_WORDS = 100_000
PART_BYTES = 1 << 20  # of texts that are split into words at once
THRESHOLD = 0.3
RUN = 4  # so many single letters in a row are one spelled-out word
NOT_LETTERS = re.compile(r"[\W_]+")
ENDS = (".", "!", "?")
START = "^"  # where a word begins


def clean(word: str) -> str:
    return NOT_LETTERS.sub("", word)


def pieces(word: str) -> list[str]:
    """A cleaned word after the sign of its start, or overlapping parts of one that is longer than ``LONGEST``."""
    word = START + word
    if len(word) <= LONGEST:
        return [word]
    return [word[at : at + LONGEST] for at in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def letters(words: list[str], width: int) -> np.ndarray:
    """Code points, padded with zero on the right."""
    out = np.zeros((len(words), width), np.uint32)
    for size in {len(w) for w in words}:
        at = [n for n, w in enumerate(words) if len(w) == size]
        if size:
            out[at, :size] = np.frombuffer("".join(words[n] for n in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)
    return out


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of padded words, row by row.

    A cell stands for subsequences that end with these two letters. Decayed sums over all cells above and to the
    left make those one letter longer.
    """
    n, m = left.shape[1], right.shape[1]
    a, b = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    same = ((a[:, None] == b) & (a[:, None] > 0)).astype(np.float32) * np.float32(DECAY * DECAY)
    if min(n, m) < LENGTH:
        return np.zeros(len(left), np.float32)
    cells, decay = same.copy(), np.float32(DECAY)
    for level in range(1, LENGTH):
        cells = cells[:-1, :-1]
        for i in range(1, len(cells)):
            cells[i] += decay * cells[i - 1]
        for j in range(1, cells.shape[1]):
            cells[:, j] += decay * cells[:, j - 1]
        cells = cells * same[level:, level:]
    return cells.sum((0, 1))


def shared(columns: np.ndarray, alphabet: np.ndarray, landmark: str) -> np.ndarray:
    """Length of the longest common subsequence of each padded word with a landmark.

    ``columns`` holds places in ``alphabet``, which has all of the landmark's letters, one row per letter position.
    """
    full = np.uint32((1 << len(landmark)) - 1)
    masks = np.zeros(len(alphabet), np.uint32)
    for n, place in enumerate(np.searchsorted(alphabet, [ord(c) for c in landmark]).tolist()):
        masks[place] |= np.uint32(1 << n)
    top = np.full(columns.shape[1], full, np.uint32)
    for column in columns:
        both = top & masks[column]
        top = ((top + both) | (top - both)) & full
    return len(landmark) - np.bitwise_count(top).astype(np.int64)


class Landmarks:
    """Kernels of words with fixed landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = letters(words, max(map(len, words), default=1))
        self.own = np.maximum(kernel(self.codes, self.codes), 1e-30) if words else np.zeros(0, np.float32)
        self.alphabet = np.union1d(self.codes, np.array([0], np.uint32))  # zero stands for every other letter too

    def features(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each cleaned word with every landmark; of a long word, the best of its parts."""
        parts, owner = [], []
        for n, word in enumerate(words):
            for part in pieces(word):
                parts.append(part)
                owner.append(n)
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not self.words:
            return out
        owner = np.array(owner, np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        # Words of like length together, so that padding costs little.
        for low, high in ((LENGTH, 8), (9, 14), (15, LONGEST)):
            chosen = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not len(chosen):
                continue
            codes = letters([parts[n] for n in chosen.tolist()], high)
            place = np.minimum(np.searchsorted(self.alphabet, codes.T), len(self.alphabet) - 1)
            place = np.where(self.alphabet[place] == codes.T, place, 0).astype(np.uint16)
            pairs = [np.flatnonzero(shared(place, self.alphabet, w) >= LENGTH) for w in self.words]
            row = np.concatenate(pairs)
            mark = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
            needed, at = np.unique(row, return_inverse=True)
            own = np.concatenate([np.zeros(0, np.float32)] + [kernel(codes[needed[k : k + PAIRS]], codes[needed[k : k + PAIRS]]) for k in range(0, len(needed), PAIRS)])
            for k in range(0, len(row), PAIRS):
                r, j = row[k : k + PAIRS], mark[k : k + PAIRS]
                value = kernel(codes[r], self.codes[j]) / np.sqrt(own[at[k : k + PAIRS]] * self.own[j])
                np.maximum.at(out, (owner[chosen[r]], j), np.minimum(value, 1))
        return out


class Sentences:
    """Sentence features of texts; words are kept from call to call."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.landmarks.words)), np.float32)
        self.ends = np.zeros(0, bool)
        self.single = np.zeros(0, bool)

    def _learn(self, words: list[str]):
        for word in words:
            self.number[word] = len(self.number)
        cleaned = list(map(clean, words))
        distinct = {w: n for n, w in enumerate(dict.fromkeys(cleaned))}
        features = self.landmarks.features(list(distinct))
        at = np.fromiter((distinct[c] for c in cleaned), np.int64, len(cleaned))
        if len(self.number) > len(self.table):
            grown = np.empty((len(self.number) * 5 // 4, len(self.landmarks.words)), np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        self.table[len(self.number) - len(words) : len(self.number)] = features[at]
        self.ends = np.concatenate([self.ends, np.fromiter((w.endswith(ENDS) for w in words), bool, len(words))])
        self.single = np.concatenate([self.single, np.fromiter((len(c) == 1 for c in cleaned), bool, len(cleaned))])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all sentences and, for each text, where its sentences begin (one more than texts)."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        split = [t.lower().split() for t in texts]
        fresh = list(set().union(*split).difference(self.number)) if split else []
        if fresh:
            self._learn(sorted(fresh))
        rows, begins = [np.zeros((0, len(self.landmarks.words)), np.float32)], [0]
        for words in split:
            count = 0
            if words:
                ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                starts = np.flatnonzero(np.concatenate([[True], self.ends[ids[:-1]]]))
                for at in range(0, len(starts), 4096):
                    some = starts[at : at + 4096]
                    stop = starts[at + 4096] if at + 4096 < len(starts) else len(ids)
                    rows.append(np.maximum.reduceat(self.table[ids[some[0] : stop]], some - some[0], axis=0))
                count = len(starts)
                spelled = self._spelled(words, self.single[ids])
                if spelled:
                    rows.append(self.landmarks.features(spelled))
                    count += len(spelled)
            begins.append(begins[-1] + count)
        return np.concatenate(rows), np.array(begins)

    @staticmethod
    def _spelled(words: list[str], single: np.ndarray) -> list[str]:
        if single.sum() < RUN:
            return []
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        return ["".join(map(clean, words[a:b])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= RUN]


def _beginnings(batches):
    """Words and their beginnings, once a document; ``doc`` tells documents of the sample apart."""
    for batch in batches:
        words, toxic, docs = [], [], []
        for doc, text, label in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            cleaned = {START + clean(w) for w in text.decode().lower().split()}
            own = {w[:n] for w in cleaned for n in range(LENGTH, min(len(w), 11) + 1)}
            words += own
            toxic += [label] * len(own)
            docs += [doc] * len(own)
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array(toxic, pa.int32()), "doc": pa.array(docs, pa.int64())})


def choose(candidates: list[tuple[str, float, set]], toxic: int, most: int) -> list[str]:
    """Candidates that reach many toxic documents not reached so far, and few others.

    ``candidates``: word, share of other documents that hold it, toxic documents that hold it.
    """
    reached: dict[int, int] = {}
    chosen: list[str] = []
    left = list(candidates)
    while left and len(chosen) < most:
        gains = [sum(0.4 ** reached.get(d, 0) for d in docs) / toxic - good for _, good, docs in left]
        best = max(range(len(left)), key=lambda n: (gains[n], len(left[n][0]), left[n][0]))
        if gains[best] <= 0.002:
            break
        word, _, docs = left.pop(best)
        chosen.append(word)
        for d in docs:
            reached[d] = reached.get(d, 0) + 1
        left = [c for c in left if not (c[0].startswith(word) or word.startswith(c[0]))]
    return chosen


def _bag_maker(words: list[str]):
    def make(batches):
        sentences = Sentences(Landmarks(words))
        for batch in (p for b in batches for p in parts_of(b, PART_BYTES, 0)):
            texts = [t.decode() for t in text_bytes(batch.column(0))]
            rows, begins = sentences.of(texts)
            bags = [rows[a:b].astype(np.float16).tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "bag": pa.array(bags, pa.binary())})

    return make


def summary(values: np.ndarray) -> tuple[float, float, float]:
    """A document's most toxic sentence, share and number of toxic ones, from its sentences' values."""
    if not len(values):
        return -1.0, 0.0, 0.0
    soft = 1 / (1 + np.exp(-np.clip(4 * values, -30, 30)))
    return float(values.max()), float(np.sqrt(soft.mean())), float(np.log1p(soft.sum()))


def fit_machine(bags: list[np.ndarray], toxic: np.ndarray, gram: np.ndarray, prior: tuple[float, float]):
    """Weights on landmark kernels, bias, and the logistic curve over ``summary`` (offset first).

    ``prior``: how many documents of either label one sampled document stands for.
    """
    values, vectors = np.linalg.eigh(gram.astype(np.float64) + 1e-2 * np.eye(len(gram)))
    root = vectors / np.sqrt(np.maximum(values, 1e-9)) @ vectors.T
    mapped = [(b if len(b) else np.zeros((1, len(gram)))) @ root for b in bags]
    sign = np.where(toxic, 1.0, -1.0)
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    rows = np.stack([m[(b.max(1) if len(b) else np.zeros(1)).argmax()] for m, b in zip(mapped, bags, strict=True)])
    weight, bias = np.zeros(rows.shape[1]), 0.0
    for _ in range(ROUNDS):
        total, total_bias = np.zeros_like(weight), 0.0
        for step in range(1, 1501):
            slack = sign * (rows @ weight + bias) < 1
            rate = 1 / (1e-3 * (step + 200))
            pull = sign * share * slack
            weight = (1 - rate * 1e-3) * weight + rate * 0.05 * (pull @ rows)
            bias += rate * 0.05 * pull.sum()
            if step > 750:
                total, total_bias = total + weight, total_bias + bias
        weight, bias = total / 750, total_bias / 750
        rows = np.stack([m[(m @ weight).argmax()] for m in mapped])
    facts = np.array([[1.0, *summary(m @ weight + bias)] for m in mapped])
    each = np.where(toxic, prior[1], prior[0])
    curve = np.zeros(facts.shape[1])
    ridge = np.array([1e-6, 0.1, 0.1, 0.1])
    for _ in range(200):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(facts @ curve, -30, 30)))
        grad = (each * (p - toxic)) @ facts + ridge * curve
        hess = (facts * (each * p * (1 - p))[:, None]).T @ facts + np.diag(ridge + 1e-6)
        curve -= np.clip(np.linalg.solve(hess, grad), -1, 1)
    return root @ weight, bias, curve


def _scorer(words, weight, bias, curve):
    weight = np.asarray(weight, np.float32)

    def score(batches):
        sentences = kept("toxic words", tuple(words), lambda: Sentences(Landmarks(words)))
        for batch in batches:
            facts = []
            for part in parts_of(batch, PART_BYTES, 2):
                rows, begins = sentences.of([t.decode() for t in text_bytes(part.column(2))])
                each = rows @ weight + bias if len(words) else np.full(len(rows), -1.0)
                facts += [(1.0, *summary(each[a:b])) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            chance = 1 / (1 + np.exp(-np.clip(np.array(facts, np.float64).reshape(-1, 4) @ curve, -30, 30)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(chance, pa.float64()), "predicted": pa.array((chance >= THRESHOLD).astype(np.int32))}
            )

    return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int = SAMPLE):
    """Landmarks, their weights, bias and curve, learned as ``score_toxicity`` says."""
    columns = _columns(docs, folds, held_out)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    known = known.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {k: min(1.0, sample / sizes.get(k, 1)) for k in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]) * (1 << 20)
    # About 2 * sample rows of two numbers, whatever the size of the tables.
    chosen = columns.join(F.broadcast(known.where(draw)), "doc_id").select("doc_id", "text", "toxic")
    words, weight, bias = [], [], 0.0
    curve = np.array([math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)), 0, 0, 0])
    if sizes.get(0) and sizes.get(1):
        bad, good = (F.count_distinct(F.when(F.col("toxic") == k, F.col("doc"))) for k in (1, 0))
        held = chosen.mapInArrow(_beginnings, "word string, toxic int, doc long")
        counts = written(held.groupBy("word").agg(bad.alias("bad"), good.alias("good"), F.collect_set(F.when(F.col("toxic") == 1, F.col("doc"))).alias("docs")))
        bad, good = F.col("bad") / (sizes[1] * rate[1]), F.col("good") / (sizes[0] * rate[0])
        telling = counts.where((F.col("bad") >= 3) & (bad > 3 * good)).orderBy(F.desc(bad - 2 * good), "word").limit(CANDIDATES)
        pool = [(r.word, r.share, set(r.docs)) for r in telling.select("word", (2 * good).alias("share"), "docs").collect()]
        words = choose(pool, max(1, round(sizes[1] * rate[1])), LANDMARKS - ORDINARY)
        plain = counts.where((F.col("good") >= 3) & (good >= bad) & (F.length("word") > LENGTH)).orderBy(F.xxhash64("word"), "word")
        words += [r.word for r in plain.limit(ORDINARY).collect()] if words else []
    if words:
        rows = chosen.select("text", "toxic").mapInArrow(_bag_maker(words), "toxic int, bag binary").collect()
        marks = Landmarks(words)
        rows.sort(key=lambda r: (r.toxic, r.bag))
        bags = [np.frombuffer(r.bag, np.float16).reshape(-1, len(words)).astype(np.float32) for r in rows]
        toxic = np.array([r.toxic == 1 for r in rows], bool)
        if toxic.any() and not toxic.all():
            gram = kernel(np.repeat(marks.codes, len(words), 0), np.tile(marks.codes, (len(words), 1))).reshape(len(words), -1)
            gram /= np.sqrt(marks.own[:, None] * marks.own)
            weight, bias, curve = fit_machine(bags, toxic, gram, (1 / rate[0], 1 / rate[1]))
        else:
            words = []
    return words, weight, bias, curve


def _columns(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), (fold("doc_id", folds) == held_out).alias("held_out"), "text")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3).

    Learns from about ``sample`` documents of either label (``labels.toxic`` 0 or 1), chosen by a hash among rows
    whose fold isn't ``held_out``; of several labels of one id the highest counts. Null and empty texts get the
    score of a text without any known word. Without documents of both labels every score is the smoothed share of
    toxic ones. Repeated rows score alike; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, folds, held_out, sample)
    kinds = "doc_id long, held_out boolean, score double, predicted int"
    return _columns(docs, folds, held_out).mapInArrow(_scorer(*model), kinds)


def _rejecter(model, place: int):
    score = _scorer(*model)

    def keep(batches):
        for batch in (p for b in batches for p in parts_of(b, PART_BYTES, place)):
            empty = pa.nulls(batch.num_rows, pa.int64())
            part = pa.RecordBatch.from_arrays([empty, pa.nulls(batch.num_rows, pa.bool_()), batch.column(place)], ["doc_id", "held_out", "text"])
            for scored in score([part]):
                yield batch.filter(pa.array([p == 0 for p in scored.column("predicted").to_pylist()], pa.bool_()))

    return keep


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all columns, in one pass without a shuffle."""
    model = fit_toxicity(docs, labels, folds, held_out, sample)
    return docs.mapInArrow(_rejecter(model, docs.columns.index("text")), docs.schema)
