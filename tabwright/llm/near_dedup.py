"""Near-duplicates by MinHash of word shingles, verified by banded alignment.

A k-mer is a shingle of ``SHINGLE`` words labelled with how often it occurred before in the text. Each of
``SKETCHES`` hash functions picks its ``PICKED`` smallest k-mers and keeps them in text order, so texts that share
k-mers in another order don't meet. For texts near the limit these are too few, so that every text also has keys of
one k-mer of ``GRAM`` words: the smallest one of each hash function, where replacing every fifth word still leaves a
quarter of the k-mers in common. Texts of up to ``SHORT`` words have an exact family besides (``short_keys``): no pair
of them that may be linked is missed. Texts that are equal word for word are one node. Nodes that share a sketch are
candidates. Large classes form in rounds: within a bucket every node is compared with the bucket's leaders, and
verified links join nodes to components. Leaders are drawn over the components of a bucket; the first round takes one
leader for each node, the others all of them. Rounds go on while they join many nodes. Then all pairs of nodes in one
bucket and different components are settled: those are found whose lengths and word counts in ``SLOTS``, then in ``FINE`` slots allow a link, by bands of length and block by block. Some of each two components are aligned first; then all that are in different components still. Alignment allows as many word edits as ``1 - SIMILARITY`` of the longer
text: the band of the table of furthest-reaching paths.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import NO_ID, Blocks, Scratch, expand, squeeze, unpack, unused_name

SHINGLE = 5
PICKED = 2
SKETCHES = 24
GRAM = 3
SHORT = 50
SIMILARITY = 0.8
MANY = 0.005  # share of the nodes that a round joins if another one is worth it
BLOCK = 4096  # nodes of a bucket that are compared in one group with as many others
SHARD_ROWS = 50_000  # rows of a task that compares blocks
CELL_PAIRS = 1024  # pairs that are aligned in one group, in the mean
LED = 256  # the same for pairs of nodes with leaders
SLOTS = 512  # of the counts of words that are compared in blocks
FINE = 2048  # slots of the counts that nodes keep: in long texts two words seldom share one
SUMMED = (16, 4)  # slots whose sums are compared before their counts, one after another: fewer are soon done, and as sure
PAIRS = 1024  # whose counts are compared at once
FEW = 256  # words for each edit that is looked for along diagonals, before the band is filled by columns
BAND_ROWS = 4096  # rows of the band that are made at once
CACHE_WORDS = 500_000
LONG_WORD = 64
ODD = np.random.default_rng(2024).integers(0, 2**63, (2, 64), np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


class Words:
    """Lower-cased words of texts as 32-bit hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        fresh = set(words).difference(known)
        for word in fresh:
            known[word] = xxhash.xxh32_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        for word in fresh:
            if len(word) > LONG_WORD:  # rare, unless a text has no white space
                del known[word]
        return hashes


def node_of(words: np.ndarray, doc_id) -> bytes:
    """What word-for-word equal texts share; texts without words stay apart by id."""
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else f"no words {doc_id}".encode())


def labelled(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the k-mers with how often each occurred before."""
    count = len(words) - shingle + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    wide = mixed(words.astype(np.uint64) * BASE + np.uint64(1))
    kmers = wide[:count].copy()
    for n in range(1, shingle):
        kmers = kmers * BASE + wide[n : n + count]
    order = np.argsort(kmers)
    ordered = kmers[order]
    again = np.zeros(count + 1, bool)
    again[1:-1] = ordered[1:] == ordered[:-1]
    if again.any():  # k-mers that occur once have label zero
        places = np.sort(order[again[1:] | again[:-1]])
        order = places[np.argsort(kmers[places], kind="stable")]
        ordered = kmers[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        label = np.arange(len(order)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(order)]])))
        kmers[order] += label.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed(kmers)


def sketch(words: np.ndarray, shingle: int = SHINGLE, sketches: int = SKETCHES) -> np.ndarray:
    """One key per hash function; none for a text shorter than a shingle."""
    kmers = labelled(words, shingle)
    count = len(kmers)
    if not count:
        return np.zeros(0, np.int64)
    out = np.empty(sketches, np.uint64)
    for at in range(0, sketches, 8):
        odd = ODD[:, at : min(at + 8, sketches)]
        values = (kmers ^ odd[0][:, None]) * odd[1][:, None]
        values ^= values >> np.uint64(32)
        rows = np.arange(len(values))
        places = []
        for _ in range(min(PICKED, count)):
            place = values.argmin(1)
            places.append(place)
            values[rows, place] = np.uint64(2**64 - 1)
        key = np.zeros(len(values), np.uint64)
        for place in np.sort(np.stack(places), 0):
            key = key * BASE + kmers[place]
        out[at : at + len(values)] = mixed(key + odd[1])
    return out.view(np.int64)


def short_keys(words: np.ndarray, similarity: float = SIMILARITY) -> set[int]:
    """K-mers of a text of up to ``SHORT`` words, of which it shares one with each text that short it may be linked to.

    If the longer of two texts has ``longer`` words and ``edits`` are allowed, some run of words between edits has at
    least a ``edits + 1``-th of the others, so a k-mer no longer than that is common to both. An edit changes at most
    ``shingle`` k-mers, so ``common`` ones are, and of all but ``common - 1`` in one order for all texts, one is.
    """
    least: dict[int, int] = {}
    for longer in range(len(words), min(SHORT, int(len(words) / similarity + 1e-6) if similarity > 0 else SHORT) + 1):
        edits = int((1 - similarity) * longer + 1e-9)
        shingle = max(1, min(GRAM, -(-(longer - edits) // (edits + 1))))
        common = max(1, longer - shingle + 1 - shingle * edits)
        least[shingle] = min(common, least.get(shingle, common))
    keys = set()
    for shingle, common in least.items():
        kmers = np.sort(labelled(words, shingle))
        keys.update(kmers[: max(0, len(kmers) - common + 1)].tolist())
    return keys


def single_keys(words: np.ndarray, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of one k-mer each: the smallest of each hash function, for short texts those of ``short_keys`` too."""
    keys = short_keys(words, similarity) if len(words) <= SHORT else set()
    if len(words) > similarity * SHORT:  # may be linked to a text that isn't short
        kmers = labelled(words, GRAM)
        for at in range(0, sketches if len(kmers) else 0, 8):
            odd = ODD[:, at : min(at + 8, sketches)]
            values = (kmers ^ odd[0][:, None]) * odd[1][:, None]
            values ^= values >> np.uint64(32)
            keys.update(kmers[values.argmin(1)].tolist())
    return np.fromiter(keys, np.uint64, len(keys)).view(np.int64)


def most_shared(a: np.ndarray, b: np.ndarray, gram: int) -> int:
    """Number of runs of ``gram`` words that both texts have, each as often as in both."""
    runs = []
    for words in (a, b):
        wide = words.astype(np.uint64) + np.uint64(1)
        count = max(0, len(words) - gram + 1)
        sums = wide[:count].copy()
        for n in range(1, gram):
            sums = mixed(sums) * BASE + wide[n : n + count]
        runs.append(sums)
    values, counts = np.unique(np.concatenate(runs), return_counts=True)
    in_a = np.bincount(np.searchsorted(values, runs[0]), minlength=len(values))
    return int(np.minimum(in_a, counts - in_a).sum())


def plain_edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of one way from ``a`` to ``b``, which may not be the shortest: words replaced, or all words between the
    anchors changed. Anchors are words found once in both texts, in an order common to both."""
    most = max(len(a), len(b))
    if len(a) == len(b):
        most = int((a != b).sum())
    once = [np.unique(x, return_index=True, return_counts=True) for x in (a, b)]
    once = [(values[counts == 1], places[counts == 1]) for values, places, counts in once]
    _, one, two = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    one, two = once[0][1][one], once[1][1][two]
    two = two[np.argsort(one)]
    one = np.sort(one)
    # The longest run of anchors that rise in both: ends of runs by length, and for each anchor the one before.
    ends, last, before = [], [], np.full(len(two), -1)
    for n, place in enumerate(two.tolist()):
        at = bisect_left(ends, place)
        before[n] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(place)
            last.append(n)
        else:
            ends[at], last[at] = place, n
    chain = []
    n = last[-1] if last else -1
    while n >= 0:
        chain.append(n)
        n = before[n]
    chain = np.array(chain[::-1], int)
    gaps = [np.diff(np.concatenate([[-1], x[chain], [len(text)]])) - 1 for x, text in ((one, a), (two, b))]
    return min(most, int(np.maximum(*gaps).sum()))


def band_edits(a: list[int], b: list[int], most: int) -> int:
    """Edits between ``a`` and ``b``, exact if they are at most ``most``, else any larger number.

    Columns of the table are whole numbers with a bit for each of ``BAND_ROWS`` rows, which say where the table rises and
    falls from row to row. Of each block of rows only the columns in the band are made; around it the table rises.
    """
    n, m = len(a), len(b)
    across = [1] * m  # how the table changes from column to column in the last row made
    corner = 0  # the table at the block's first column, in the row before the block
    for start in range(0, n, BAND_ROWS):
        stop = min(n, start + BAND_ROWS)
        left, right = max(0, start - most), min(m, stop + most)
        corner += sum(across[max(0, start - BAND_ROWS - most) : left]) if start else 0
        places: dict[int, int] = {}
        for at, word in enumerate(a[start:stop]):
            places[word] = places.get(word, 0) | 1 << at
        full, last = (1 << stop - start) - 1, 1 << stop - start - 1
        rises, falls = full, 0
        for column in range(left, right):
            step, equal = across[column], places.get(b[column], 0)
            upright = equal | falls
            if step < 0:
                equal |= 1
            level = ((((equal & rises) + rises) ^ rises) | equal) & full
            up, down = falls | full ^ (level | rises), rises & level
            across[column] = 1 if up & last else -1 if down & last else 0
            up, down = up << 1 | (step > 0), down << 1 | (step < 0)
            rises, falls = (down | ~(upright | up)) & full, up & upright & full
        across[right:] = [1] * (m - right)
        corner += stop - start
    return corner + sum(across[max(0, (n - 1) // BAND_ROWS * BAND_ROWS - most) :]) if n else m


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether word edits are at most ``1 - similarity`` of the longer text's words."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    in_a = np.bincount(np.searchsorted(values, a), minlength=len(values))
    if max(len(a), len(b)) - int(np.minimum(in_a, counts - in_a).sum()) > most:
        return False  # even in any order too few words agree
    for gram in (2, 3):  # an edit changes as many runs of words as a run has words
        if most_shared(a, b, gram) < max(len(a), len(b)) - gram + 1 - gram * most:
            return False
    if plain_edits(a, b) <= most:
        return True
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    if not len(differ):
        return True
    a, b = a[differ[0] :], b[differ[0] :]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    cut = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    n, m = len(a), len(b)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, m) + 1, BASE)]))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(x.astype(np.uint64) * BASE + np.uint64(1)) * power[: len(x)])]) for x in (a, b)]
    steps = [1 << p for p in reversed(range(max(1, min(n, m).bit_length())))]

    def slide(x, k):
        """Furthest position in ``a`` along diagonal k = position in b - position in a."""
        x = x.copy()
        for step in steps:
            y = x + k
            ok = (x + step <= n) & (y + step <= m)
            if not ok.any():
                continue
            xs, ys = x[ok], y[ok]
            same = (sums[0][xs + step] - sums[0][xs]) * power[ys] == (sums[1][ys + step] - sums[1][ys]) * power[xs]
            x[np.flatnonzero(ok)[same]] += step
        return x

    below = -(n + m + 9)
    reach = np.full(2 * most + 3, below, np.int64)  # of diagonal k at k + most + 1
    for edits in range(min(most, max(n, m) // FEW) + 1):
        lo, hi = max(-edits, -most), min(edits, most)
        k = np.arange(lo, hi + 1)
        at = k + most + 1
        if edits:
            # a word replaced, a word of b put in, a word of a left out
            x = np.maximum(np.maximum(reach[at] + 1, reach[at - 1]), reach[at + 1] + 1)
        else:
            x = np.zeros(1, np.int64)
        x = np.minimum(np.minimum(x, n), m - k)
        live = (x >= 0) & (x + k >= 0)
        x[~live] = below
        x[live] = slide(x[live], k[live])
        new = np.full_like(reach, below)
        new[at] = x
        reach = new
        if lo <= m - n <= hi and reach[m - n + most + 1] >= n:
            return True
    return edits < most and band_edits(a.tolist(), b.tolist(), most) <= most


def signature(words: np.ndarray, slots: int = SLOTS) -> bytes:
    """Word counts in slots, four bits each and at most 15. An edit changes their sum of differences by two at most."""
    places = (mixed(words.astype(np.uint64) * BASE + np.uint64(7)) >> np.uint64(20)).astype(np.int64) % slots
    counts = np.minimum(np.bincount(places, minlength=slots), 15).astype(np.uint8)
    return (counts[::2] << 4 | counts[1::2]).tobytes()


def packed_counts(signatures: pa.Array, slots: int = SLOTS) -> np.ndarray:
    """Two counts a byte, a row for each signature."""
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, slots // 2)


def fine_counts(signatures: pa.Array) -> np.ndarray:
    """Rows of ``packed_counts`` of squeezed signatures in ``FINE`` slots."""
    unpacker = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(map(unpacker.decompress, signatures.to_pylist())), np.uint8).reshape(-1, FINE // 2)


def coarse(fine: np.ndarray) -> np.ndarray:
    """The signatures in ``SLOTS`` slots of the texts with these in ``FINE`` slots."""
    out = np.empty((len(fine), SLOTS // 2), np.uint8)
    for at in range(0, len(fine), PAIRS):
        some = fine[at : at + PAIRS].reshape(-1, FINE // SLOTS, SLOTS // 2)
        high, low = (np.minimum(counts.sum(1, dtype=np.uint8), 15) for counts in (some >> 4, some & 15))
        out[at : at + PAIRS] = high << 4 | low
    return out


def summed(packed: np.ndarray, runs: int) -> np.ndarray:
    """Sums of ``runs`` counts, at most 255. They lie apart by the number of sums, so that a sum is the count of a slot of fewer."""
    out = np.empty((len(packed), SLOTS // runs), np.uint8)
    for at in range(0, len(packed), PAIRS):
        some = packed[at : at + PAIRS]
        counts = np.stack([some >> 4, some & 15], 2).reshape(-1, runs, SLOTS // runs)
        out[at : at + PAIRS] = np.minimum(counts.sum(1, dtype=np.uint16), 255)
    return out


def apart_by(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of the differences of bytes, row by row."""
    return (np.maximum(left, right) - np.minimum(left, right)).sum(1, dtype=np.int32)


def agreeing(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, packed: bool = True) -> np.ndarray:
    """Of pairs of rows ``a`` of ``left`` and ``b`` of ``right``, whether the sum of differences is at most ``most``. Rows
    are bytes, or with ``packed`` two counts a byte."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), PAIRS):
        one, two = left[a[at : at + PAIRS]], right[b[at : at + PAIRS]]
        differ = apart_by(one >> 4, two >> 4) + apart_by(one & 15, two & 15) if packed else apart_by(one, two)
        keep[at : at + PAIRS] = differ <= most[at : at + PAIRS]
    return keep


def block_pairs(group: np.ndarray, apart: np.ndarray, part: np.ndarray, guest: np.ndarray, component: np.ndarray, words: np.ndarray, signs: np.ndarray, similarity: float):
    """Places of the pairs that may be linked: of one group, which is a run, in different components, not both guests, and
    of different parts where ``apart``. ``signs``: of ``packed_counts``."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.repeat(np.concatenate([heads[1:], [len(group)]]), np.diff(np.concatenate([heads, [len(group)]])))
    levels = [*((summed(signs, runs), False) for runs in SUMMED), (signs, True)]
    one, two = [], []
    live, step = np.arange(len(group)), 1
    while len(live := live[live + step < ends[live]]):
        a, b = live, live + step
        keep = (component[a] != component[b]) & ~(apart[a] & (part[a] == part[b])) & ~(guest[a] & guest[b])
        a, b = a[keep], b[keep]
        most = np.floor((1 - similarity) * np.maximum(words[a], words[b]) + 1e-9)
        keep = np.abs(words[a] - words[b]) <= most
        a, b, most = a[keep], b[keep], most[keep]
        for counts, packed in levels:
            keep = agreeing(counts, counts, a, b, 2 * most, packed)
            a, b, most = a[keep], b[keep], most[keep]
        one.append(a)
        two.append(b)
        step += 1
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64),) * 2


def fine_agreeing(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of rows of ``fine_counts``, whether counts and lengths allow a link. Words put in or left out change one
    count each, and there are as many of them at least as the lengths differ by."""
    most, differ = np.floor((1 - similarity) * np.maximum(words_a, words_b) + 1e-9), np.abs(words_a - words_b)
    return (differ <= most) & agreeing(left, right, a, b, 2 * most - differ)


def _pairer(similarity: float):
    """Rows in order of blocks: pairs of nodes that may be linked. Blocks are not cut by batches.

    ``tag`` holds the part of its bucket that a node is in, whether it is a guest, and whether two parts meet.
    """

    def pairs(table):
        columns = {n: table.column(n).combine_chunks() for n in table.column_names}
        block, tag, words, component = (columns[n].to_numpy() for n in ("block", "tag", "words", "component"))
        new = np.ones(table.num_rows, bool)
        new[1:] = block[1:] != block[:-1]
        fine, words = fine_counts(columns["signature"]), words.astype(np.int64)
        one, two = block_pairs(np.cumsum(new), tag & 1 > 0, tag >> 2, tag & 2 > 0, component, words, coarse(fine), similarity)
        keep = fine_agreeing(fine, fine, one, two, words[one], words[two], similarity)
        one, two = one[keep], two[keep]
        return pa.RecordBatch.from_arrays([columns["node"].take(pa.array(one)), columns["node"].take(pa.array(two))], ["one", "two"])

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            block = table.column("block").to_numpy()
            last = np.flatnonzero(block[1:] != block[:-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            left = table.slice(cut)
            if cut:
                yield pairs(table.slice(0, cut))
        if left is not None and left.num_rows:
            yield pairs(left)

    return run


# A document's number names its block and its place there, so that its text is found again without a shuffle of texts.
PLACES = 20  # bits of the place in a block, which has fewer documents than bytes / 16
MADE = 14  # bits of the block's place among its task's


def first_number(block: int) -> int:
    return (block >> 32) << MADE + PLACES | (block & (1 << 32) - 1) << PLACES


def block_of(number):
    """Column of the block that a column of document numbers names."""
    made = F.shiftright(number, PLACES).bitwiseAND(F.lit((1 << MADE) - 1))
    return F.shiftleft(F.shiftright(number, MADE + PLACES), 32).bitwiseOR(made)


NODES = "number long, doc_id long, mark long, node binary, words int"


def _nodes(batches):
    """Each document of a block: its number, and the node it belongs to."""
    words = Words()
    for batch in batches:
        for block, ids, lens, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block & (1 << 32) - 1 >= 1 << MADE:
                raise ValueError("a task has too many blocks; read the documents in smaller parts")
            ids, bounds, data = unpack(ids, lens, text)
            texts = [words.of(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            known = [None if i == NO_ID else int(i) for i in ids]
            yield pa.RecordBatch.from_pydict(
                {
                    "number": pa.array(first_number(block) + np.arange(len(ids)), pa.int64()),
                    "doc_id": pa.array(known, pa.int64()),
                    "mark": pa.array([json.loads(line)["mark"] for line in expand(extra).split(b"\n")], pa.int64()),
                    "node": pa.array([node_of(w, i) for w, i in zip(texts, known, strict=True)], pa.binary()),
                    "words": pa.array([len(w) for w in texts], pa.int32()),
                }
            )


def _wanted_texts(packed, wanted, make):
    """``make`` of the words of each wanted document of one block, with its number."""
    if not packed.num_rows or not wanted.num_rows:
        return
    block, ids, lens, text = (packed.column(c)[0].as_py() for c in ("block", "ids", "lens", "text"))
    _, bounds, data = unpack(ids, lens, text)
    words, first = Words(), first_number(block)
    for number in sorted(wanted.column("number").to_pylist()):
        at = number - first
        yield number, make(words.of(data[bounds[at] : bounds[at + 1]]))


def _sketcher(shingle: int, sketches: int, similarity: float):
    def keys(words):
        return np.unique(np.concatenate([sketch(words, shingle, sketches), single_keys(words, sketches, similarity)]))

    def run(packed, wanted):
        found = list(_wanted_texts(packed, wanted, lambda w: (len(w), squeeze(signature(w, FINE)), keys(w))))
        return pa.table(
            {
                "node": pa.array([n for n, _ in found], pa.int64()),
                "words": pa.array([w for _, (w, *_) in found], pa.int32()),
                "signature": pa.array([s for _, (_, s, _) in found], pa.binary()),
                "keys": pa.array([k for _, (*_, k) in found], pa.list_(pa.int64())),
            }
        )

    return run


def _tokens(packed, wanted):
    found = list(_wanted_texts(packed, wanted, lambda w: squeeze(w.tobytes())))
    return pa.table({"node": pa.array([n for n, _ in found], pa.int64()), "tokens": pa.array([t for _, t in found], pa.binary())})


def _likely(similarity: float):
    """Pairs that may be linked by their lengths and by the counts in their signatures."""

    def run(batches):
        for batch in batches:
            words = [batch.column(n).to_numpy().astype(np.int64) for n in ("words_a", "words_b")]
            every = np.arange(batch.num_rows)
            keep = fine_agreeing(*(fine_counts(batch.column(n)) for n in ("left", "right")), every, every, *words, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _aligner(similarity: float):
    def align(pairs, texts):
        tokens = dict(zip(texts.column("node").to_pylist(), texts.column("tokens").to_pylist(), strict=True))
        keep = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            keep.append(similar(np.frombuffer(expand(tokens[a]), np.uint32), np.frombuffer(expand(tokens[b]), np.uint32), similarity))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return align


def in_cells(pairs: DataFrame, number: int) -> DataFrame:
    """(cell, a, b) of ``number`` pairs. A cell is where two shares of the nodes meet, so that a node that is in many pairs is in
    few cells: no more than there are shares."""
    shares = max(1, math.ceil(math.sqrt(2 * number / CELL_PAIRS)))
    a, b = (F.pmod(F.xxhash64(n, F.lit(-2)), F.lit(shares)) for n in ("a", "b"))
    return pairs.select((F.least(a, b) * shares + F.greatest(a, b)).alias("cell"), "a", "b")


def by_leaders(pairs: DataFrame, number: int) -> DataFrame:
    """(cell, a, b) of ``number`` pairs that are stars around few nodes. Most nodes are in one pair and so in one cell; one
    that is in more than ``LED`` pairs is in a cell for each so many."""
    degrees = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    for end in ("a", "b"):
        pairs = pairs.join(degrees.select(F.col("node").alias(end), F.col("degree").alias(f"of_{end}")), end)
    leads = F.col("of_a") >= F.col("of_b")
    leader, led = F.when(leads, F.col("a")).otherwise(F.col("b")), F.when(leads, F.col("b")).otherwise(F.col("a"))
    share = F.pmod(F.xxhash64(led, F.lit(-3)), F.ceil(F.greatest("of_a", "of_b") / F.lit(LED)))
    return pairs.select(F.pmod(F.xxhash64(leader, share), F.lit(max(1, -(-number // LED)))).alias("cell"), "a", "b")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Component of every node of (a, b) links: the smallest node of it. Columns node, component.

    With ``scratch`` the result is one of its tables, and those of the rounds are deleted.
    """
    scratch = scratch or Scratch(links.sparkSession)
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.least("component", "least").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("root"))
        new = scratch.write(step.join(jump, "next").select("node", F.least("next", "root").alias("component"), F.col("component").alias("old")))
        if not new.where("component <> old").limit(1).count():
            scratch.drop(both, new)
            return labels
        after = scratch.write(new.select("node", "component"))
        scratch.drop(labels, new)
        labels = after


def _ends(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b) with their components, of_a and of_b."""
    for end in ("a", "b"):
        if labels is None:
            links = links.withColumn(f"of_{end}", F.col(end))
            continue
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        links = links.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return links


def _with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def extended(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after more links: these are drawn between components, so that only merged ones are worked on."""
    between = scratch.write(_ends(links, labels).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a <> b").distinct())
    merged = components(between, scratch)
    root = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    # A component is one of its nodes; other ends of links had no label so far.
    new = scratch.write(old.union(merged.join(labels.select("node"), "node", "left_anti").select("node", "component")))
    scratch.drop(between, merged, labels)
    return new


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """Class of every document: doc_id, class_id (smallest id of the class), class_size, n_words.

    Two texts are linked if they share a key (all of up to ``SHORT`` words do that may be linked) and the word edits between them are at most ``1 - similarity`` of
    the longer one; classes are connected by links. Words are split at ASCII white space and lower-cased in A-Z.
    Texts equal word for word are always one class. Texts without words, null
    ones too, stand alone. A null id is never the class id unless the class has no other. Other columns are ignored.
    """
    return _classed(docs, shingle, similarity, sketches).select("doc_id", "class_id", "class_size", "n_words")


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest id, null last; of equal ids any one text."""
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "mark")
    kept = _classed(docs, shingle, similarity, sketches).groupBy("component").agg(F.min(first).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    own = unused_name("mark", docs.columns)
    marked = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col(own) == F.col("kept_mark"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _leader_pairs(current: DataFrame, number: int, similarity: float) -> DataFrame:
    """Nodes with the leaders of their buckets; a large component is as likely to lead as a single node."""
    order = F.struct(F.xxhash64("component", F.lit(number)).alias("order"), F.xxhash64("node", F.lit(number)).alias("within"), "node", "words", "component")
    sides = [side(c).alias(name) for c, names in ((order, ("first", "last")), ("component", ("low", "high"))) for side, name in zip((F.min, F.max), names, strict=True)]
    leaders = current.groupBy("key").agg(*sides).where("low <> high")  # several components meet here
    leaders = leaders.select("key", F.explode(F.array("first", "last")).alias("leader"))
    near = F.least("words", "leader.words") >= F.lit(similarity) * F.greatest("words", "leader.words")
    pairs = current.join(leaders, "key").where((F.col("component") != F.col("leader.component")) & near)
    if not number:  # one leader for each node first: most copies meet in it, and later rounds skip them
        pairs = pairs.groupBy("node").agg(F.min("leader").alias("leader"))
    return pairs.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def _open_pairs(current: DataFrame, rooms: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """All pairs of one bucket in different components that may be linked by their lengths and signatures."""
    # Lengths of two texts that may be linked lie in one band or in bands next to each other. Each node is also a guest
    # of the next band; guests are compared with the band's own nodes.
    band = F.floor(F.log(F.greatest("words", F.lit(1))) / F.lit(math.log(1 / max(similarity, 0.01)) + 1e-6)).cast("int")
    rows = current.join(rooms.select("key"), "key").withColumn("band", band)
    rows = rows.select("key", "node", "words", "component", F.inline(F.array(*[F.struct((F.col("band") + n).alias("band"), F.lit(n).alias("guest")) for n in (0, 1)])))
    group = ["key", "band"]
    alive = rows.groupBy(*group).agg(F.count("*").alias("nodes"), F.sum("guest").alias("guests"), F.min(F.when(F.col("guest") == 0, F.col("words"))).alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
    alive = alive.where("guests < nodes and low <> high").select(*group, "least", F.ceil(F.col("nodes") / F.lit(BLOCK)).cast("int").alias("parts"))
    reached = (F.col("guest") == 0) | (F.col("words") >= F.lit(similarity) * F.col("least") - 1)  # guests that some of the band may be linked to
    members = rows.join(alive, group).where(reached).withColumn("part", F.pmod(F.xxhash64("node", F.lit(-1)), "parts").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Two groups of one hash are compared with each other as well, which does no harm.
    block = F.xxhash64(*group, F.least("part", "other"), F.greatest("part", "other"))
    tag = F.col("part") * 4 + F.col("guest") * 2 + (F.col("part") != F.col("other")).cast("int")
    members = members.select(block.alias("block"), tag.alias("tag"), "node", "words", F.xxhash64("component").alias("component"))
    members = members.join(sketched.select("node", "signature"), "node")
    shards = max(1, -(-members.count() // SHARD_ROWS))
    members = members.repartition(shards, "block").sortWithinPartitions("block").select("block", "tag", "node", "words", "component", "signature")
    pairs = members.mapInArrow(_pairer(similarity), "one long, two long")
    return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def _classed(docs: DataFrame, shingle: int, similarity: float, sketches: int) -> DataFrame:
    """doc_id, mark (of its text), component, class_id, class_size and n_words of every document, written."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = Blocks(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark")), carry=["mark"])
    rows = scratch.write(blocks.table.mapInArrow(_nodes, NODES))
    first = F.min("number").alias("first")
    nodes = scratch.write(rows.groupBy("node").agg(first, F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))

    wanted = nodes.select(F.col("first").alias("number")).withColumn("block", block_of(F.col("number")))
    sketched = blocks.answer(wanted, _sketcher(shingle, sketches, similarity), "node long, words int, signature binary, keys array<long>")
    sketched = scratch.write(sketched)
    every = sketched.select("node", "words", F.explode("keys").alias("key"))  # a text's keys differ
    shared = every.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key")
    entries = scratch.write(every.join(shared, "key"))

    labels = _linked(entries, sketched, blocks, similarity, scratch)
    component = F.col("first") if labels is None else F.coalesce("component", "first")
    of_node = nodes if labels is None else nodes.join(labels.withColumnRenamed("node", "first"), "first", "left")
    of_node = of_node.select("node", "copies", "doc_id", component.alias("component"))
    sums = of_node.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    of_node = scratch.write(of_node.drop("doc_id").join(sums, "component"))
    classed = rows.select("doc_id", "mark", "node", F.col("words").alias("n_words"))
    result = Scratch(spark).write(with_facts(classed, of_node, "node").drop("node", "copies"))
    scratch.clear()
    blocks.drop()
    return result


HEAVY = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``facts``, which hold each key once with its number of ``copies`` in the rows.

    Keys with a ``HEAVY``-th of the rows or more, of which there are no more than that, are joined by broadcast.
    """
    total = facts.agg(F.sum("copies")).first()[0] or 0
    heavy = F.col("copies") * HEAVY >= F.lit(total)
    few = F.broadcast(facts.where(heavy))
    rest = rows.join(few.select(key), key, "left_anti").join(facts.where(~heavy), key)
    return rows.join(few, key).unionByName(rest)


def _linked(entries: DataFrame, sketched: DataFrame, blocks: Blocks, similarity: float, scratch: Scratch) -> DataFrame | None:
    """Component of every node with links (node, component); None without links."""
    entered, nodes_in = entries.count(), entries.select("node").distinct().count()
    labels, checked, number, joined = None, None, 0, 0

    def aligned(pairs: DataFrame, compared: bool) -> DataFrame:
        sides = [sketched.select(F.col("node").alias(n), F.col("words").alias(f"words_{n}"), F.col("signature").alias(s)) for n, s in (("a", "left"), ("b", "right"))]
        likely = pairs if compared else pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_likely(similarity), "a long, b long")
        likely = scratch.write(likely)
        wanted = likely.select(F.col("a").alias("number")).union(likely.select("b")).distinct().withColumn("block", block_of(F.col("number")))
        tokens = scratch.write(blocks.answer(wanted, _tokens, "node long, tokens binary"))
        # Each cell gets the words of its nodes once, however many pairs they are in.
        cells = (in_cells if compared else by_leaders)(likely, likely.count())
        nodes = cells.select("cell", F.col("a").alias("node")).union(cells.select("cell", "b")).distinct()
        texts = nodes.join(tokens, "node").select(F.col("cell").alias("met"), "node", "tokens")
        links = scratch.write(cells.groupBy("cell").cogroup(texts.groupBy("met")).applyInArrow(_aligner(similarity), "a long, b long"))
        scratch.drop(likely, tokens)
        return links

    def joined_by(pairs: DataFrame, compared: bool = False) -> DataFrame | None:
        links, after = aligned(pairs, compared), labels
        if links.limit(1).count():
            after = components(links, scratch) if labels is None else extended(labels, links, scratch)
        scratch.drop(links)
        return after

    rooms = None
    while True:
        current = _with_component(entries.select("key", "node", "words"), labels)
        counts = current.groupBy("key", "component").agg(F.count("*").alias("nodes")).groupBy("key")
        counts = counts.agg(F.sum("nodes").alias("nodes"), F.sum(F.col("nodes").cast("double") * F.col("nodes")).alias("known"))
        scratch.drop(rooms)
        rooms = scratch.write(counts.withColumn("open", F.col("nodes").cast("double") * F.col("nodes") - F.col("known")).where("open > 0"))
        still_open = (rooms.agg(F.sum("open")).first()[0] or 0) / 2
        before, joined = joined, labels.where("node <> component").count() if labels is not None else 0
        if not still_open or number and (still_open <= entered or joined - before <= MANY * nodes_in):
            break
        pairs = _leader_pairs(current, number, similarity)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs)
        checked = pairs if checked is None else checked.union(pairs)
        labels = joined_by(pairs)
        number += 1
    if still_open:
        pairs = _open_pairs(current, rooms, sketched, similarity)
        pairs = scratch.write(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"))
        for some in (1, 32, 0):
            left = pairs.count()
            if not left:
                break
            if some and left > nodes_in:  # so many of each two components first: what they join needs no more
                apart = F.pmod(F.xxhash64("a", "b"), F.lit(some))
                part = _ends(pairs, labels).groupBy("of_a", "of_b", apart).agg(F.min(F.struct("a", "b")).alias("pair"))
                part = scratch.write(part.select("pair.a", "pair.b"))
                labels = joined_by(part, True)
                rest = _ends(pairs.join(part, ["a", "b"], "left_anti"), labels)
                after = scratch.write(rest.where("of_a <> of_b").select("a", "b"))
                scratch.drop(pairs, part)
                pairs = after
            else:
                labels = joined_by(pairs, True)  # counts were compared in blocks
                break
    return labels
