"""Scoring texts with a hierarchical Pitman-Yor model of words in their context and of their letters.

Every word that stands before another has a restaurant: its customers are the training tokens that follow it, its
dishes words. The first token of a text follows the end. The parent of all of them is the restaurant of words without
context, whose customers are their tables. The name of a new dish comes from below: restaurants of letters, one per
context of three bytes, whose parents are the restaurants of the contexts shortened by their oldest byte, down to one
without context over a uniform base. Contexts with one ending share their parents. So every word has a probability
after every other, seen or not. Customers of the lowest level are the tables of the word restaurant.

As for the base score, all words that training hasn't seen are one kind in ``score``: its probability is what the
word restaurant gives to new dishes, less what the letters give to known words. ``spelled_score`` spells them out.

Seating is sampled by Gibbs: a sweep draws the number of tables of every dish from its conditional, given the other
dishes' tables and the parent's probabilities at the start of the sweep. Up to ``EXACT`` customers the conditional is
exact (generalised Stirling numbers); further customers of a dish are seated in blocks. Tables of the contexts'
restaurants and probabilities of words are averaged over the sweeps after ``BURN``, so that each context's sum to one.

Documents are coded once: a block holds its distinct words in the order of their hashes, and the words of its texts as
places in that list. Blocks send their words to shards by hash and get their places there, then send each distinct
pair once, to the shard of its second word, with the first word's place and the training count. So a shard has its
words with all pairs that end in them. Shards send the tables of each context to the shard of the context's word and
get the sum of all back, for contexts with a pair whose tables can change. Shards send distinct byte sequences to the
restaurants of their last context byte, and get probabilities back. Blocks get, at last, their words' probabilities
and their pairs' customers and tables. What belongs to a shard lies in buckets by shard and is not shuffled again.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import BLOCK_BYTES, NO_ID, Bucketed, Scratch, expand, expand_array, squeeze, squeeze_array, text_bytes

CONTEXT = 3
EXACT = 64
SWEEPS = 4
BURN = 1
WORD_STRENGTH = 1.0
PAIR_STRENGTH = 1.0
LETTER_DISCOUNT = 0.5
LETTER_STRENGTH = 1.0
INNER = 2
SHARD_BYTES = 8 << 20
LEAST_SHARDS, MOST_SHARDS = 64, 1 << 16
PLACE_BITS = 40
END = b" "  # a token no text can hold: the end of a text, spelled as the empty word; the first word follows it
CODED = "block long, ids binary, lens binary, words binary, ranges binary, trained binary, codes binary"
SENT = "shard int, block long, words binary, trained binary"
LEXICON = "shard int, block long, words binary, counts binary"
PAIRS = "shard int, block long, own binary, lens binary, prevs binary, at binary, trained binary"
HOUSE = "shard int, block long, words binary, counts binary, prevs binary, lens binary, at binary, seen binary"
SPELLED = "last int, shard int, codes binary, customers binary"
MAIL = "shard int, kind int, data binary"
BACK = "block long, shard int, scores binary, counts binary, rooms binary, seen binary, tables binary"
STATE = -1  # the block of rows that are a shard's own

# Kinds of mail. Numbers from 0 to 255 are answers of the letters by the last byte of the context.
TABLES, MOVED, SUMS, TOTAL, ROOMS, ROOM_SUMS, FACTS = range(-1, -8, -1)
OF_ROOMS, ASKS, TELLS = 1 << 20, 2 << 20, 3 << 20  # plus the sender's number


def held_out(doc_id, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers."""
    x = np.asarray(x, np.float64)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: rows customers, columns tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(most):
        stay = np.full(most, -np.inf)
        stay[:c] = table[c, 1 : c + 1] + np.log(c - discount * np.arange(1, c + 1))
        table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


def draw_tables(rng, counts, others, log_base, discount: float, strength: float, numbers: np.ndarray) -> np.ndarray:
    """Tables of each dish, from its conditional.

    ``others``: tables of the restaurant's other dishes; ``log_base``: the parent's log probability of the dish.
    """
    counts = np.asarray(counts, np.int64)
    tables = np.minimum(counts, 1)
    start = strength / discount + others
    exact = np.minimum(counts, EXACT)
    for low, high in ((2, 4), (5, 16), (17, EXACT)):  # no number of tables above the customers has weight
        rows = np.flatnonzero((exact >= low) & (exact <= high))
        for at in range(0, len(rows), 20_000):
            some = rows[at : at + 20_000]
            t = np.arange(1, high + 1)
            weight = numbers[exact[some], 1 : high + 1] + t * (log_base[some] + np.log(discount))[:, None]
            weight += lgamma(start[some][:, None] + t) - lgamma(start[some])[:, None]
            tables[some] = 1 + (weight + rng.gumbel(size=weight.shape)).argmax(1)
    rows = np.flatnonzero(counts > EXACT)
    seated = np.full(len(rows), EXACT, np.int64)
    while len(rows):
        block = np.minimum(counts[rows] - seated, np.maximum(1, seated // 16))
        open_new = (strength + discount * (others[rows] + tables[rows])) * np.exp(log_base[rows])
        chance = open_new / (open_new + seated - discount * tables[rows])
        tables[rows] += rng.binomial(block, np.clip(chance, 0, 1))
        seated += block
        left = seated < counts[rows]
        rows, seated = rows[left], seated[left]
    return tables


def predictive(counts, tables, total, total_tables, log_base, discount: float, strength: float) -> np.ndarray:
    """Log probability of each dish in its restaurant."""
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(counts - discount * tables, 0))
    return np.logaddexp(own, np.log(strength + discount * total_tables) + log_base) - np.log(strength + total)


def packed(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return packed(schema, **{n: [r[i] for r in rows] for i, n in enumerate(names)})


def squeeze_steps(values: np.ndarray) -> bytes:
    """Bytes of numbers that mostly rise, by their steps."""
    return squeeze_array(np.diff(np.asarray(values, np.int64), prepend=np.int64(0)))


def expand_steps(data: bytes) -> np.ndarray:
    return np.cumsum(expand_array(data, np.int64))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shards_of(ranges: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words by the upper 16 bits of their hashes; they rise with the hash."""
    return ranges.astype(np.int64) * shards >> 16


def slices(sorted_keys: np.ndarray):
    """Each key with the bounds of its run."""
    cuts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, np.int64)
    return [(int(sorted_keys[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def learns(ids: np.ndarray, folds: int) -> np.ndarray:
    return np.fromiter((not held_out(None if i == NO_ID else i, folds) for i in ids.tolist()), bool, len(ids))


def code_block(ids: list[int], texts: list[bytes], folds: int):
    """Distinct words by hash, the upper bits of the hashes, training counts, and the texts as places of words."""
    place: defaultdict = defaultdict(count().__next__)
    place[END]  # noqa: B018
    parts = []
    for text in texts:
        words = text.lower().split()
        words.append(END)
        parts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
    words = list(place)
    hashes = hashes_of(words)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = rank[np.concatenate(parts)]
    trained = np.bincount(codes[np.repeat(learns(np.array(ids, np.int64), folds), lens)], minlength=len(words))
    return [words[n] for n in order.tolist()], (hashes[order] >> np.uint64(48)).astype(np.uint16), trained, lens, codes


def _coder(folds: int):
    def code(batches):
        first = TaskContext.get().partitionId() << 32
        made, ids, texts, size = 0, [], [], 0

        def flush():
            words, ranges, trained, lens, codes = code_block(ids, texts, folds)
            return rows_of(
                CODED,
                [(first + made, squeeze_array(np.array(ids, np.int64)), squeeze_array(lens), squeeze(b"\n".join(words)), squeeze_array(ranges), squeeze_array(trained), squeeze_array(codes))],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                size += len(text) + 16
                if size >= BLOCK_BYTES:
                    yield flush()
                    made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield flush()

    return code


def _sender(shards: int):
    """Words of blocks, to their shards."""

    def send(batches):
        for batch in batches:
            for block, words, ranges, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, trained = expand(words).split(b"\n"), expand_array(trained, np.int64)
                runs = slices(shards_of(expand_array(ranges, np.uint16), shards))
                yield rows_of(SENT, [(s, block, squeeze(b"\n".join(words[a:b])), squeeze_array(trained[a:b])) for s, a, b in runs])

    return send


def _merge(key, table):
    """A shard's words by hash with their training counts, and for each block the places of its words."""
    blocks, lists = table.column("block").to_pylist(), [expand(w).split(b"\n") for w in table.column("words").to_pylist()]
    place: defaultdict = defaultdict(count().__next__)
    at = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in lists]
    words = list(place)
    hashes = hashes_of(words)
    order = sorted(range(len(words)), key=lambda n: (hashes[n], words[n])) if len(np.unique(hashes)) < len(words) else np.argsort(hashes).tolist()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    counts = np.zeros(len(words), np.int64)
    for some, trained in zip(at, table.column("trained").to_pylist(), strict=True):
        counts[rank[some]] += expand_array(trained, np.int64)
    shard = key[0].as_py()
    rows = [(shard, STATE, squeeze(b"\n".join(words[n] for n in order)), squeeze_array(counts))]
    rows += [(shard, block, squeeze_steps(rank[some]), b"") for block, some in zip(blocks, at, strict=True)]
    return pa.Table.from_batches([rows_of(LEXICON, rows)])


def context_pairs(codes: np.ndarray, lens: np.ndarray, kinds: int, end: int):
    """For each token a number for the pair of the word and the one before it, words first; and the word before."""
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[np.cumsum(lens) - lens] = end
    return codes.astype(np.int64) * kinds + before, before


def end_place(words: bytes) -> int:
    return expand(words).split(b"\n").index(END)


def _pairer(shards: int, folds: int):
    """Distinct pairs of a block, to the shards of their second words."""

    def pair(blocks, replies):
        rows = []
        if blocks.num_rows:
            block, ids, lens, words, ranges, codes = (blocks.column(n)[0].as_py() for n in ("block", "ids", "lens", "words", "ranges", "codes"))
            lens, codes, own = expand_array(lens, np.int64), expand_array(codes, np.int32), shards_of(expand_array(ranges, np.uint16), shards)
            places = dict(zip(replies.column("shard").to_pylist(), replies.column("words").to_pylist(), strict=True))
            here = np.concatenate([expand_steps(places[s]) for s in sorted(places)])
            numbers = (own << PLACE_BITS) + here
            keys, _ = context_pairs(codes, lens, len(own), end_place(words))
            keys = np.sort(keys * 2 + np.repeat(learns(expand_array(ids, np.int64), folds), lens))
            trains, keys = keys & 1, keys >> 1
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            trained, keys = np.add.reduceat(trains, first), keys[first]
            second, before = np.divmod(keys, len(own))
            for s, a, b in slices(own):
                low, high = np.searchsorted(second, [a, b])
                kinds, at = np.unique(before[low:high], return_inverse=True)
                rows.append(
                    (s, block, squeeze_steps(here[a:b]), squeeze_array(np.bincount(second[low:high] - a, minlength=b - a).astype(np.int32)), squeeze_steps(numbers[kinds]), squeeze_array(at.astype(np.int32)), squeeze_array(trained[low:high].astype(np.int32)))
                )
        return pa.Table.from_batches([rows_of(PAIRS, rows)])

    return pair


def _gather(lexicon, sent):
    """A shard's pairs with their training counts, and for each block the places of its words and pairs (0: not trained)."""
    if not lexicon.num_rows:
        return pa.Table.from_batches([rows_of(HOUSE, [])])
    shard, words, counts = (lexicon.column(n)[0].as_py() for n in ("shard", "words", "counts"))
    number_of_words = len(expand_array(counts, np.int64))
    before = [expand_steps(p) for p in sent.column("prevs").to_pylist()]
    kinds = np.unique(np.concatenate(before))
    keys = []
    for own, lens, prevs, at in zip(sent.column("own").to_pylist(), sent.column("lens").to_pylist(), before, sent.column("at").to_pylist(), strict=True):
        keys.append(np.repeat(expand_steps(own), expand_array(lens, np.int32)) * len(kinds) + np.searchsorted(kinds, prevs)[expand_array(at, np.int32)])
    joined = np.concatenate(keys)
    trained = np.concatenate([expand_array(t, np.int32) for t in sent.column("trained").to_pylist()])
    learnt, trained = joined[trained > 0], trained[trained > 0]
    del joined
    order = np.argsort(learnt, kind="stable")
    learnt = learnt[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(learnt)), bool), learnt[1:] != learnt[:-1]]))
    seen = np.add.reduceat(trained[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    pairs = learnt[first]
    word, prev = np.divmod(pairs, len(kinds))
    used = np.unique(prev)
    rows = [
        (shard, STATE, words, counts, squeeze_steps(kinds[used]), squeeze_array(np.bincount(word, minlength=number_of_words).astype(np.int32)), squeeze_array(np.searchsorted(used, prev).astype(np.int32)), squeeze_array(seen))
    ]
    for block, own, asked in zip(sent.column("block").to_pylist(), sent.column("own").to_pylist(), keys, strict=True):
        place = np.searchsorted(pairs, asked)
        known = np.concatenate([pairs, [-1]])[place] == asked
        rows.append((shard, block, own, b"", squeeze_steps(np.where(known, place + 1, 0)), b"", b"", b""))
    return pa.Table.from_batches([rows_of(HOUSE, rows)])


class Seats:
    """What a shard knows of its pairs: the word and the context of each, its customers, and which can change tables."""

    def __init__(self, row: dict):
        self.counts = expand_array(row["counts"], np.int64)
        self.prevs = expand_steps(row["prevs"])
        self.at = expand_array(row["at"], np.int32)
        self.seen = expand_array(row["seen"], np.int64)
        self.word = np.repeat(np.arange(len(self.counts)), expand_array(row["lens"], np.int32))
        self.moving = np.flatnonzero(self.seen > 1)  # a single customer always has one table
        self.ones = np.bincount(self.word[self.seen == 1], minlength=len(self.counts))
        self.asked, self.room = np.unique(self.at[self.moving], return_inverse=True)

    def customers(self, moved: np.ndarray) -> np.ndarray:
        """Customers of the shard's words: the tables of all pairs that end in them."""
        return self.ones + np.bincount(self.word[self.moving], moved, len(self.counts)).astype(np.int64)

    def asks(self, shard: int, changed: np.ndarray) -> list[tuple]:
        """Mail with the change of the moving pairs' tables, by context, to the shards of the contexts' words."""
        return letters_to(ASKS + shard, self.prevs[self.asked], np.bincount(self.room, changed, len(self.asked)).astype(np.int64))


def letters_to(kind: int, numbers: np.ndarray, change: np.ndarray) -> list[tuple]:
    places = numbers & ((1 << PLACE_BITS) - 1)
    return [(s, kind, squeeze_array(np.concatenate([places[a:b], change[a:b]]))) for s, a, b in slices(numbers >> PLACE_BITS)]


def mail_of(table) -> dict[int, bytes]:
    return dict(zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True))


def _opening(batches):
    """One table for every dish, and the first mail."""
    for batch in batches:
        for row in batch.to_pylist():
            shard, seats = row["shard"], Seats(row)
            moved = np.ones(len(seats.moving), np.int64)
            customers = seats.customers(moved)
            tables = np.minimum(customers, 1)
            none = np.zeros(len(tables), np.int64)
            facts = [seats.counts.sum(), (seats.counts > 0).sum(), customers.sum(), tables.sum()]
            facts += [(n == m).sum() for n in (seats.seen, customers) for m in (1, 2)]
            rows = [(TABLES, tables), (MOVED, moved), (SUMS, moved * 0), (TOTAL, np.full(len(tables), -np.inf)), (ROOMS, none), (ROOM_SUMS, none), (FACTS, np.array(facts, np.float64))]
            mail = [(shard, kind, squeeze_array(values)) for kind, values in rows]
            mail += letters_to(TELLS + shard, seats.prevs, np.bincount(seats.at, minlength=len(seats.prevs)))
            mail += seats.asks(shard, np.zeros(len(moved), np.int64))
            yield rows_of(MAIL, mail)


def _router(sampled: bool):
    """Tables of all restaurants of the shard's words as contexts: takes changes and answers with the sums."""

    def route(key, table):
        shard = key[0].as_py()
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        rooms, sums = (expand_array(data[kinds.index(k)], np.int64).copy() for k in (ROOMS, ROOM_SUMS))
        if sampled:
            sums += rooms
        asked = []
        for kind, letter in zip(kinds, data, strict=True):
            if kind >= ASKS:
                places, change = np.split(expand_array(letter, np.int64), 2)
                rooms[places] += change
                if kind < TELLS:
                    asked.append((kind - ASKS, places))
        rows = [(shard, ROOMS, squeeze_array(rooms)), (shard, ROOM_SUMS, squeeze_array(sums))]
        rows += [(sender, OF_ROOMS + shard, squeeze_array(rooms[places])) for sender, places in asked]
        return pa.Table.from_batches([rows_of(MAIL, rows)])

    return route


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte sequences (three of context, one letter) of the spelled words, and where each word begins."""
    words = [b"" if w == END else w for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    buffer = b" " * CONTEXT + (b" " * (CONTEXT + 1)).join(words) + b" "
    codes = np.ndarray((len(buffer) - CONTEXT,), ">u4", buffer, 0, (1,))
    begins = np.cumsum(lengths + CONTEXT + 1) - (lengths + CONTEXT + 1)
    keep = np.ones(len(codes), bool)
    gaps = (begins + lengths + 1)[:-1]
    for n in range(CONTEXT):
        keep[gaps + n] = False
    return codes[keep].astype(np.uint32), np.cumsum(lengths + 1) - (lengths + 1)


def _speller(house, mail):
    """Distinct sequences of each shard with their customers, by the last byte of the context."""
    rows = []
    if house.num_rows:
        shard, words = house.column("shard")[0].as_py(), expand(house.column("words")[0].as_py()).split(b"\n")
        codes, begins = grams(words)
        customers = np.repeat(expand_array(mail_of(mail)[TABLES], np.int64), np.diff(np.concatenate([begins, [len(codes)]])))
        distinct, at = np.unique(codes, return_inverse=True)
        customers = np.bincount(at, customers, len(distinct)).astype(np.int64)
        last = (distinct >> np.uint32(8)) & np.uint32(255)
        for byte in np.unique(last).tolist():
            own = last == byte
            rows.append((byte, shard, squeeze_array(distinct[own]), squeeze_array(customers[own])))
    return pa.Table.from_batches([rows_of(SPELLED, rows)])


def letter_model(codes: np.ndarray, customers: np.ndarray, log_root: np.ndarray, rng):
    """Log probability of each sequence's letter in its context, and the tables that the root gets as customers.

    ``codes`` are distinct and share the last context byte, so all their restaurants but the root are here.
    """
    levels = []
    here, count = codes, customers
    for depth in range(CONTEXT, 0, -1):
        mask = np.uint32((1 << 8 * (depth + 1)) - 1)
        keys, up = np.unique(here & mask, return_inverse=True)
        count = np.bincount(up, count, len(keys)).astype(np.int64) if depth < CONTEXT else np.bincount(up, customers, len(keys)).astype(np.int64)
        _, room = np.unique(keys >> np.uint32(8), return_inverse=True)
        levels.append({"keys": keys, "up": up, "room": room, "count": count, "tables": np.minimum(count, 1)})
        here, count = keys, levels[-1]["tables"]
    numbers = stirling(LETTER_DISCOUNT)

    def settle():
        """Customers of each level are the tables below; probabilities from the root down."""
        for below, level in zip(levels[:-1], levels[1:], strict=True):
            level["count"] = np.bincount(level["up"], below["tables"], len(level["keys"])).astype(np.int64)
            level["tables"] = np.clip(level["tables"], np.minimum(level["count"], 1), level["count"])
        base = log_root[(levels[-1]["keys"] & np.uint32(255)).astype(np.int64)]
        for n in range(len(levels) - 1, -1, -1):
            level = levels[n]
            level["base"] = base
            customers_of = np.bincount(level["room"], level["count"])
            tables_of = np.bincount(level["room"], level["tables"])
            level["log"] = predictive(level["count"], level["tables"], customers_of[level["room"]], tables_of[level["room"]], base, LETTER_DISCOUNT, LETTER_STRENGTH)
            if n:
                base = level["log"][levels[n - 1]["parent"]]

    for n, level in enumerate(levels[:-1]):
        level["parent"] = levels[n + 1]["up"]
    settle()
    for _ in range(INNER):
        for level in levels:
            others = np.bincount(level["room"], level["tables"])[level["room"]] - level["tables"]
            level["tables"] = draw_tables(rng, level["count"], others, level["base"], LETTER_DISCOUNT, LETTER_STRENGTH, numbers)
        settle()
    root = np.zeros(256, np.int64)
    np.add.at(root, (levels[-1]["keys"] & np.uint32(255)).astype(np.int64), levels[-1]["tables"])
    return levels[0]["log"][levels[0]["up"]], root


def _letters(log_root: np.ndarray, sweep: int):
    def answer(key, table):
        codes = [expand_array(c, np.uint32) for c in table.column("codes").to_pylist()]
        customers = [expand_array(c, np.int64) for c in table.column("customers").to_pylist()]
        shards = table.column("shard").to_pylist()
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        summed = np.bincount(at, np.concatenate(customers), len(distinct)).astype(np.int64)
        last = key[0].as_py()
        logs, root = letter_model(distinct, summed, log_root, np.random.default_rng([sweep, last]))
        parts = np.split(logs[at], np.cumsum([len(c) for c in codes])[:-1])
        data = [squeeze_array(p.astype(np.float32)) for p in parts] + [squeeze_array(root)]
        return pa.Table.from_batches([packed(MAIL, shard=[*shards, -1], kind=[last] * len(data), data=data)])

    return answer


def _sweep(sweep: int, customers_now: int, tables_now: int, discount: float, pair_discount: float):
    def step(house, mail):
        if not house.num_rows:
            return pa.Table.from_batches([rows_of(MAIL, [])])
        row = house.to_pylist()[0]
        shard, seats, post = row["shard"], Seats(row), mail_of(mail)
        tables, moved, sums = (expand_array(post[k], np.int64) for k in (TABLES, MOVED, SUMS))
        total = expand_array(post[TOTAL], np.float64)
        codes, begins = grams(expand(row["words"]).split(b"\n"))
        distinct, at = np.unique(codes, return_inverse=True)
        last = (distinct >> np.uint32(8)) & np.uint32(255)
        logs = np.empty(len(distinct))
        for byte in np.unique(last).tolist():
            logs[last == byte] = expand_array(post[byte], np.float32)
        base = np.add.reduceat(logs[at], begins)
        word = predictive(seats.customers(moved), tables, customers_now, tables_now, base, discount, WORD_STRENGTH)
        if sweep >= BURN:
            total, sums = np.logaddexp(total, word), sums + moved
        rooms = [expand_array(post[k], np.int64) for k in sorted(post) if OF_ROOMS <= k < ASKS]
        rooms = np.concatenate([*rooms, np.zeros(0, np.int64)])[seats.room]
        rng = np.random.default_rng([sweep, shard, 1])
        drawn = draw_tables(rng, seats.seen[seats.moving], (rooms - moved).astype(np.float64), word[seats.word[seats.moving]], pair_discount, PAIR_STRENGTH, stirling(pair_discount))
        customers = seats.customers(drawn)
        tables = np.clip(tables, np.minimum(customers, 1), customers)
        after = draw_tables(rng, customers, np.maximum(tables_now - tables, 0).astype(np.float64), base, discount, WORD_STRENGTH, stirling(discount))
        facts = np.array([np.exp(base[seats.counts > 0]).sum(), customers.sum(), after.sum()])
        rows = [(shard, k, squeeze_array(v)) for k, v in ((TABLES, after), (MOVED, drawn), (SUMS, sums), (TOTAL, total), (FACTS, facts))]
        return pa.Table.from_batches([rows_of(MAIL, rows + seats.asks(shard, drawn - moved))])

    return step


def _replier(samples: int):
    """For each block the facts of its words and of its pairs, in its order."""

    def reply(house, mail):
        rows = []
        if house.num_rows:
            parts, post = house.to_pylist(), mail_of(mail)
            seats = Seats(next(r for r in parts if r["block"] == STATE))
            shard = parts[0]["shard"]
            scores = (expand_array(post[TOTAL], np.float64) - np.log(samples)).astype(np.float32)
            rooms = expand_array(post[ROOM_SUMS], np.int64)
            tables = np.full(len(seats.seen), samples, np.int64)
            tables[seats.moving] = expand_array(post[SUMS], np.int64)
            seen, tables = np.concatenate([[0], seats.seen]), np.concatenate([[0], tables])
            for part in parts:
                if part["block"] != STATE:
                    words, pairs = expand_steps(part["words"]), expand_steps(part["prevs"])
                    values = (scores[words], seats.counts[words], rooms[words], seen[pairs], tables[pairs])
                    rows.append((part["block"], shard, *map(squeeze_array, values)))
        return pa.Table.from_batches([rows_of(BACK, rows)])

    return reply


def _finisher(folds: int, tokens: int, kinds: int, log_new: float, samples: int, pair_discount: float):
    def finish(blocks, replies):
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score")
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        out = {n: [] for n in names}
        if blocks.num_rows:
            ids, lens, codes = (expand_array(blocks.column(n)[0].as_py(), k) for n, k in (("ids", np.int64), ("lens", np.int64), ("codes", np.int32)))
            order = np.argsort(replies.column("shard").to_numpy()).tolist()
            gather = lambda name, kind: np.concatenate([expand_array(replies.column(name)[n].as_py(), kind) for n in order])
            spelled, counts, rooms = gather("scores", np.float32).astype(np.float64), gather("counts", np.int64), gather("rooms", np.int64)
            one_kind = np.where(counts > 0, spelled, log_new)
            base = np.log10((counts + 0.1) / (tokens + 0.1 * (kinds + 1)))
            below = np.log(PAIR_STRENGTH + counts)
            back = np.log(PAIR_STRENGTH + pair_discount * rooms / samples) - below
            keys, before = context_pairs(codes, lens, len(counts), end_place(blocks.column("words")[0].as_py()))
            at = np.argsort(keys, kind="stable")
            new = np.concatenate([[False], keys[at][1:] != keys[at][:-1]])
            place = np.empty(len(keys), np.int64)
            place[at] = np.cumsum(new)
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(gather("seen", np.int64) - pair_discount * gather("tables", np.int64) / samples, 0))[place] - below[before]
            starts = np.cumsum(lens) - lens
            total = lambda values: np.add.reduceat(values, starts)
            scores = [total(np.logaddexp(own, back[before] + p[codes])) / np.log(10) for p in (one_kind, spelled)]
            out = dict(zip(names, ([None if i == NO_ID else i for i in ids.tolist()], ~learns(ids, folds), lens, total((counts > 0)[codes].astype(np.int64)), np.full(len(ids), tokens), total(base[codes]), *scores), strict=True))
        return pa.table({n: pa.array(out[n], kind) for n, kind in zip(names, types, strict=True)})

    return finish


def discount_of(once: float, twice: float) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def facts_of(mail: DataFrame) -> np.ndarray:
    """Sums of the shards' facts: one short row a shard."""
    rows = [expand_array(r.data, np.float64) for r in mail.where(F.col("kind") == FACTS).select("data").collect()]
    return np.sum(rows, axis=0) if rows else np.zeros(8)


def score_texts(docs: DataFrame, folds: int = 10, sweeps: int = SWEEPS) -> DataFrame:
    """Log probability of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score.

    Learns from documents whose id's CRC-32 (as text) modulo ``folds`` isn't 0; a null id is held out. Tokens are
    words between ASCII white space, lower-cased in A-Z, then one end. ``base_score`` is the smoothed unigram score,
    ``score`` the model's, where each token depends on the one before; both are sums of log10 probabilities. A null or
    empty text is its end alone. Repeated rows count as often as they occur; other columns are ignored; an empty table
    gives an empty one.
    """
    if sweeps <= BURN:
        raise ValueError(f"more than {BURN} sweeps are needed")
    scratch = Scratch(docs.sparkSession)
    blocks = Bucketed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coder(folds), CODED), "block")
    size = blocks.table.agg(F.sum(F.length("codes") + F.length("words"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, 1 << int(size // SHARD_BYTES).bit_length()))
    answer = lambda replies, function, schema: blocks.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(function, schema)
    sent = blocks.table.select("block", "words", "ranges", "trained").mapInArrow(_sender(shards), SENT)
    lexicon = scratch.write(sent.groupBy("shard").applyInArrow(_merge, LEXICON))
    pairs = answer(lexicon.where(F.col("block") != STATE), _pairer(shards, folds), PAIRS)
    own = lexicon.where(F.col("block") == STATE).groupBy("shard")
    house = Bucketed(own.cogroup(pairs.groupBy("shard")).applyInArrow(_gather, HOUSE), "shard")
    scratch.drop(lexicon)
    state = house.table.where(F.col("block") == STATE)
    at_house = lambda mail, function, schema: state.groupBy("shard").cogroup(mail.groupBy("shard")).applyInArrow(function, schema)
    routed = F.col("kind").isin(ROOMS, ROOM_SUMS) | (F.col("kind") >= ASKS)

    mail = scratch.write(state.mapInArrow(_opening, MAIL))
    tokens, kinds, customers, tables, *singles = facts_of(mail)
    pair_discount, discount = discount_of(*singles[:2]), discount_of(*singles[2:])
    rooms = scratch.write(mail.where(routed).groupBy("shard").applyInArrow(_router(False), MAIL))
    log_root = np.full(256, -np.log(256))
    new = []
    for sweep in range(sweeps):
        spelled = at_house(mail.where(F.col("kind") == TABLES), _speller, SPELLED)
        answers = scratch.write(spelled.groupBy("last").applyInArrow(_letters(log_root, sweep), MAIL))
        # The root's customers: at most 256 rows of 256 numbers.
        root = sum((expand_array(r.data, np.int64) for r in answers.where("shard = -1").select("data").collect()), np.zeros(256, np.int64))
        flat = np.full(256, -np.log(256))
        rng = np.random.default_rng([sweep, 2])
        start = np.minimum(root, 1)
        seated = draw_tables(rng, root, (start.sum() - start).astype(np.float64), flat, LETTER_DISCOUNT, LETTER_STRENGTH, stirling(LETTER_DISCOUNT))
        known = F.col("kind").isin(TABLES, MOVED, SUMS, TOTAL)
        post = mail.where(known).unionByName(answers.where("shard >= 0")).unionByName(rooms.where((F.col("kind") >= OF_ROOMS) & (F.col("kind") < ASKS)))
        after = scratch.write(at_house(post, _sweep(sweep, int(customers), int(tables), discount, pair_discount), MAIL))
        totals = rooms.where(F.col("kind").isin(ROOMS, ROOM_SUMS)).unionByName(after.where(F.col("kind") >= ASKS))
        further = scratch.write(totals.groupBy("shard").applyInArrow(_router(sweep >= BURN), MAIL))
        scratch.drop(mail, answers, rooms)
        mail, rooms = after, further
        log_root = predictive(root, seated, root.sum(), seated.sum(), flat, LETTER_DISCOUNT, LETTER_STRENGTH)
        spelt, customers_then, tables_then = facts_of(mail)[:3]
        if sweep >= BURN:
            new.append((WORD_STRENGTH + discount * tables) / (WORD_STRENGTH + customers) * max(1e-12, 1 - spelt))
        customers, tables = customers_then, tables_then
    samples = sweeps - BURN
    post = mail.where(F.col("kind").isin(SUMS, TOTAL)).unionByName(rooms.where(F.col("kind") == ROOM_SUMS))
    reply = house.table.groupBy("shard").cogroup(post.groupBy("shard")).applyInArrow(_replier(samples), BACK)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double"
    return answer(reply, _finisher(folds, int(tokens), int(kinds), float(np.log(np.mean(new))), samples, pair_discount), schema)
