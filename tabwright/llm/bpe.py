"""Byte-level byte-pair encoding by a pair occurrence index, and decoding.

The distinct words of a part of a partition are encoded together. An index maps every mergeable pair to all its
positions in those words. Active ranks are applied in ascending order: each replaces its pair at all positions at
once and moves the positions whose neighbours changed to the lists of the pairs they now begin.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import gathered, kept, parts_of, record, text_bytes

# How byte-level vocabularies split text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same where some letters or numbers count as other signs.
STRICT_PATTERN = (
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{newer}]]+| ?[\p{{N}}--[{newer}]]+| ?[[^\s\p{{L}}\p{{N}}][{newer}]]+|\s+(?!\S)|\s+"
)
PART_BYTES = 2 << 20
CACHE_WORDS = 600_000
LONG_WORD = 64  # characters of a word whose ids are kept; longer ones are rare unless there is no white space
RESULT = [
    ("doc_id", pa.int64()),
    ("n_tokens", pa.int64()),
    ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()),
    ("ids", pa.binary()),
    ("decoded", pa.string()),
]


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@lru_cache(maxsize=1)
def newer_signs() -> str:
    """Letters and numbers that the tokenizers library doesn't know as such yet, as ranges of a character class.

    They are found by its own word splitter: a letter goes into one word with an ``a`` before it, a number with a ``1``.
    """
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    newer: list[int] = []
    for kind, lead in ((r"\p{L}", "1a"), (r"\p{N}", "a1")):
        signs = regex.findall(kind, every)
        for at in range(0, len(signs), 1 << 14):
            some = signs[at : at + (1 << 14)]
            ends = {start: end for _, (start, end) in splitter.pre_tokenize_str("".join(lead + s for s in some))}
            newer += [ord(s) for n, s in enumerate(some) if ends.get(3 * n + 1, 0) < 3 * n + 3]
    runs: list[list[int]] = []
    for c in sorted(newer):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class PairIndexEncoder:
    """Encodes and decodes with a vocabulary file of a byte-level BPE tokenizer.

    ``newer``: what ``newer_signs`` gives, for words as the library splits them.
    """

    def __init__(self, path: str, newer: str = ""):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.tokens = [b""] * size
        for token, number in vocab.items():
            self.tokens[number] = bytes(letters[c] for c in token)
        for token, number in added.items():
            self.tokens[number] = token.encode()
        self.added = {t: number.to_bytes(4, "little") for t, number in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(WORD_PATTERN)
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.beyond = regex.compile(f"[{newer[:10]}-\\U0010ffff]") if newer else None
        self.strict = regex.compile(STRICT_PATTERN.format(newer=newer)) if newer else None
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left << 32 | self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        size = len(symbols)
        follow = np.arange(1, size + 1, dtype=np.int32)
        before = np.arange(-1, size - 1, dtype=np.int32)
        full = lengths > 0
        follow[ends[full] - 1] = -1
        before[(ends - lengths)[full]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions, ranks):
            real = ranks >= 0
            positions, ranks = positions[real], ranks[real]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for a, b, rank in zip(bounds[:-1], bounds[1:], ranks[bounds[:-1]].tolist(), strict=True):
                if rank in index:
                    index[rank].append(positions[a:b])
                else:
                    index[rank] = [positions[a:b]]
                    heapq.heappush(active, rank)

        inner = np.flatnonzero(follow >= 0).astype(np.int32)
        enter(inner, self._ranks(symbols[inner], symbols[inner + 1]))
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = np.unique(np.concatenate(found)) if len(found) > 1 or a == b else found[0]
            second = follow[at]
            real = (symbols[at] == a) & (second >= 0) & (symbols[second] == b)
            at, second = at[real], second[real]
            if not len(at):
                continue
            if a == b:  # overlapping pairs of one letter: from the left, every second
                chain, taken = set(), []
                for p, q in zip(at.tolist(), second.tolist(), strict=True):
                    if p not in chain:
                        taken.append(p)
                        chain.add(q)
                at = np.array(taken, np.int32)
                second = follow[at]
            after = follow[second]
            symbols[at] = new
            symbols[second] = -1
            follow[at] = after
            there = after >= 0
            before[after[there]] = at[there]
            front = before[at]
            has = front >= 0
            positions = np.concatenate([front[has], at[there]])
            if len(positions):
                enter(positions, self._ranks(symbols[positions], symbols[follow[positions]]))
        alive = symbols >= 0
        stops = 4 * np.concatenate([[0], np.cumsum(alive)])[ends]
        data = symbols[alive].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def split(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order."""
        words = self.words
        # Few texts have signs from the first newer one on, fewer have a newer one.
        if self.newer is not None and self.beyond.search(text) and self.newer.search(text):
            words = self.strict
        if self.split_added is None or not any(t in text for t in self.added):
            return words.findall(text)
        out = []
        for n, part in enumerate(self.split_added.split(text)):
            out += [part] if n % 2 else words.findall(part)
        return out

    def encode(self, texts: Iterable[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text; ``cache`` keeps the ids of words from call to call."""
        if len(cache) > CACHE_WORDS:
            cache.clear()
        cache.update(self.added)
        # Each distinct word is held once; texts are numbers of words, which take a tenth of the words themselves.
        number = defaultdict(count().__next__)
        placed = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in map(self.split, texts)]
        fresh = [w for w in number if w not in cache]
        found = dict(zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True))
        packed = [cache[w] if w in cache else found[w] for w in number]
        cache.update({w: ids for w, ids in found.items() if len(w) <= LONG_WORD})
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        table, begins = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(lengths) - lengths
        return [gathered(table, begins[at], lengths[at]).tobytes() for at in placed]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(path: str, newer: str, with_ids: bool, with_text: bool):
    def run(batches):
        encoder, cache = kept("pair index", (path, newer), lambda: (PairIndexEncoder(path, newer), {}))
        for part in (p for batch in batches for p in parts_of(batch, PART_BYTES)):
            doc_ids = part.column(0).to_pylist()
            encoded = encoder.encode((t.decode() for t in text_bytes(part.column(1))), cache)
            decoded = [encoder.decode(e).decode("utf-8", "replace") for e in encoded]
            sha = lambda data: hashlib.sha256(data).hexdigest()
            yield record(
                RESULT,
                doc_id=doc_ids,
                n_tokens=[len(e) // 4 for e in encoded],
                ids_sha256=list(map(sha, encoded)),
                decoded_sha256=[sha(t.encode()) for t in decoded],
                ids=encoded if with_ids else [None] * len(encoded),
                decoded=decoded if with_text else [None] * len(encoded),
            )

    return run


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids`` (little-endian 32-bit numbers)
    and ``decoded``; else these two are null. A null text is empty: no token. Added tokens of the file are found in
    the text. Rows keep no order; repeated rows give repeated rows; other columns are ignored.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoder(path, newer_signs(), with_ids, with_text), kinds)
