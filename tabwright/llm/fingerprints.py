"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two of them that differ in ``BITS`` bits at most differ in as many bytes at most, so that
at least ``8 - BITS`` (positions, byte) entries are common to both: the count that the filter asks for. Of four groups of
positions one is common as a whole, which is where the two meet: distinct fingerprints are dealt by the bytes of each of
four groups of two positions. Where more than ``ROOM`` meet, they are dealt again by one more group of the positions that
are left, until five bytes are common. In each meeting an inverted index of the other positions and bytes tallies how
many entries each pair shares; pairs that reach the count are verified bit by bit. With five bytes in common every pair
reaches the count, and the partners are looked up by their bits instead. A meeting sends on the links of a spanning
forest only, so that they grow with the fingerprints, not with the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import text_bytes, written
from tabwright.llm.near_dedup import components

SHINGLE = 3
SEED = 42
BITS = 3
ROOM = 1024  # fingerprints that meet at most before they are dealt again
PAIRS_AT_ONCE = 4_000_000
PIECE = 1 << 20  # bytes of a text whose words are held at once
SPACE = re.compile(rb"[\x20\x09-\x0D]")
HEAVY = 1000  # fingerprints of at least one part in so many of all documents are joined by broadcast


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at white space."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        cut = end.start() if end else len(text)
        yield text[at:cut]
        at = cut


def fingerprint(text: bytes, shingle: int = SHINGLE) -> tuple[int, int]:
    """SimHash of a text's word shingles, repeats included, and its number of words."""
    digest, words_in, total = xxhash.xxh64_intdigest, 0, 0
    ones = np.zeros(64, np.int64)
    tail: list[bytes] = []
    for piece in _pieces(text):
        own = piece.lower().split()
        words_in += len(own)
        words = tail + own
        count = len(words) - shingle + 1
        if count > 0:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate([[0], ends[: count - 1]]).tolist()
            stops = (ends[shingle - 1 :] - 1).tolist()
            hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), ">u8", count)
            for at in range(0, count, 1 << 16):
                some = hashes[at : at + (1 << 16)]
                ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += count
            words = words[count:]
        tail = words
    if not total and tail:
        one = digest(b" ".join(tail), SEED)
        return one, words_in
    bits = np.packbits(2 * ones > total) if total else np.zeros(8, np.uint8)
    return int.from_bytes(bits.tobytes(), "big"), words_in


def _printer(shingle: int):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.array([p for p, _ in prints], np.uint64).view(np.int64)),
                    pa.array([n for _, n in prints], pa.int64()),
                ],
                ["doc_id", "print", "n_words"],
            )

    return run


def byte_mask(positions) -> int:
    """A 64-bit mask of byte positions, 0 for the highest byte, as a signed number."""
    mask = sum(0xFF << (56 - 8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def next_masks(common: tuple[int, ...], bits: int = BITS) -> list[tuple[int, ...]]:
    """Positions to deal by for fingerprints with ``common`` bytes equal: one of these sets is equal as a whole too.

    The other positions are cut into ``bits + 1`` groups of nearly equal size, and at most ``bits`` of them differ.
    None if too few are left for that.
    """
    left = [p for p in range(8) if p not in common]
    if len(left) < bits + 1:
        return []
    return [tuple(sorted([*common, *left[n :: bits + 1]])) for n in range(bits + 1)]


def _masks_by_level(bits: int) -> list[list[tuple[int, ...]]]:
    levels = [next_masks((), bits)]
    while True:
        following = sorted({after for common in levels[-1] for after in next_masks(common, bits)})
        if not following:
            return levels
        levels.append(following)


def forest(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """The smallest place each place is connected to by links between places."""
    root = np.arange(size)
    while len(one):
        low = np.minimum(root[one], root[two])
        np.minimum.at(root, root[one], low)
        np.minimum.at(root, root[two], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    return root


def counted_pairs(group: np.ndarray, prints: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one group that share ``least`` or more positional bytes.

    ``group`` numbers the groups. For each position the rows of a group with one byte there form a list; the tally
    counts in how many lists a pair is.
    """
    size, codes = len(prints), []
    octets = prints.astype(">u8").view(np.uint8).reshape(-1, 8)
    for position in range(8):
        key = group * 256 + octets[:, position]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.repeat([*heads[1:], size], np.diff([*heads, size]))
        live, step = np.arange(size), 1
        while len(live := live[live + step < ends[live]]):
            codes.append(order[live] * size + order[live + step])  # stable order: the first place is smaller
            step += 1
    if not codes:
        return (np.zeros(0, np.int64),) * 2
    pairs, shared = np.unique(np.concatenate(codes), return_counts=True)
    pairs = pairs[shared >= least]
    return pairs // size, pairs % size


def _verified(prints: np.ndarray, one: np.ndarray, two: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    close = np.bitwise_count(prints[one] ^ prints[two]) <= bits
    return one[close], two[close]


def looked_up(prints: np.ndarray, free: int, bits: int) -> np.ndarray:
    """Smallest connected place of each of a sorted run of fingerprints that differ in the ``free`` mask only.

    Every pattern of up to ``bits`` free bits is flipped in all of them, so the work grows with their number.
    """
    size = len(prints)
    root = np.arange(size)
    ones = [np.uint64(1 << n) for n in range(64) if free >> n & 1]
    for flips in range(1, bits + 1):
        for some in combinations(ones, flips):
            wanted = prints ^ np.bitwise_or.reduce(some)
            at = np.minimum(np.searchsorted(prints, wanted), size - 1)
            one = np.flatnonzero((prints[at] == wanted) & (root[at] != root))
            if len(one):
                merged = forest(root[one], root[at[one]], size)
                root = merged[root]
    return root


def _linker(bits: int):
    """Rows in order of mask and common bytes; links of each meeting's fingerprints to the first they are connected to."""

    def links(masks: np.ndarray, prints: np.ndarray):
        """Of whole meetings."""
        common = prints & masks
        new = np.ones(len(prints), bool)
        new[1:] = (masks[1:] != masks[:-1]) | (common[1:] != common[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff([*heads, len(prints)])
        at = 0
        while at < len(heads):
            work = np.cumsum(sizes[at:].astype(np.float64) ** 2)
            more = max(1, int(np.searchsorted(work, PAIRS_AT_ONCE, side="right")))
            lo, hi = int(heads[at]), int(heads[at] + sizes[at : at + more].sum())
            some = prints[lo:hi]
            if more == 1 and sizes[at] > ROOM:  # dealt by as many bytes as can be: the rest is open
                order = np.argsort(some)
                some = some[order]
                root = looked_up(some, ~int(masks[lo]) & (2**64 - 1), bits)
            else:
                group = np.repeat(np.arange(more), sizes[at : at + more])
                root = forest(*_verified(some, *counted_pairs(group, some, 8 - bits), bits), len(some))
            moved = np.flatnonzero(root != np.arange(len(some)))
            yield some[moved], some[root[moved]]
            at += more

    def run(batches):
        masks, prints = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def send(masks, prints):
            for a, b in links(masks, prints):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held, open_rows = [], 0
        for batch in batches:
            held.append([batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in (0, 1)])
            open_rows += batch.num_rows
            if open_rows < 2 * len(masks) + 10_000:
                continue
            masks, prints = (np.concatenate([old, *new]) for old, new in zip((masks, prints), zip(*held, strict=True), strict=True))
            held, open_rows = [], 0
            common = prints & masks
            last = np.flatnonzero((masks != masks[-1]) | (common != common[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from send(masks[:cut], prints[:cut])
            masks, prints = masks[cut:], prints[cut:]
        if held:
            masks, prints = (np.concatenate([old, *new]) for old, new in zip((masks, prints), zip(*held, strict=True), strict=True))
        if len(prints):
            yield from send(masks, prints)

    return run


def _dealt(prints: DataFrame, masks) -> DataFrame:
    masks = [F.lit(byte_mask(m)) for m in masks]
    return prints.withColumn("mask", F.explode(F.array(*masks))).withColumn("common", F.col("print").bitwiseAND(F.col("mask")))


def links_between(prints: DataFrame, bits: int = BITS, room: int = ROOM) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of ``prints`` within ``bits`` bits of each other, at any length.

    Column ``print`` holds each fingerprint once. At most 3 bits: with more, too few bytes stay common.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    spark = prints.sparkSession
    shards = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels = _masks_by_level(bits)
    entries, found = _dealt(prints.select("print"), levels[0]), []
    following = {byte_mask(m): [byte_mask(after) for after in next_masks(m, bits)] for level in levels for m in level}
    for number in range(len(levels)):
        meetings = entries.groupBy("mask", "common").agg(F.count("*").alias("members")).where("members > 1")
        meetings = written(meetings)
        deeper = F.col("members") > room
        last = number == len(levels) - 1
        if last:
            deeper = F.lit(False)
        else:  # masks with too few positions left end here too
            deeper = deeper & F.col("mask").isin([m for m, after in following.items() if after])
        own = entries.join(meetings.where(~deeper).select("mask", "common"), ["mask", "common"]).select("mask", "print", "common")
        own = own.repartition(shards, "mask", "common").sortWithinPartitions("mask", "common", "print").drop("common")
        found.append(written(own.mapInArrow(_linker(bits), "a long, b long")))
        if last or not meetings.where(deeper).limit(1).count():
            break
        # The same fingerprint may come by two ways to one deeper meeting.
        step = F.create_map(*[x for m, after in following.items() if after for x in (F.lit(m), F.array(*map(F.lit, after)))])
        entries = entries.join(meetings.where(deeper).select("mask", "common"), ["mask", "common"])
        entries = entries.select("print", F.explode(F.element_at(step, F.col("mask"))).alias("mask"))
        entries = written(entries.distinct().withColumn("common", F.col("print").bitwiseAND(F.col("mask"))))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, room: int = ROOM) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest id that links lead to) and n_words of every document.

    Words are split at ASCII white space and lower-cased in A-Z. Texts of fewer words than a shingle are one shingle;
    texts without words and null texts have fingerprint zero and link like any other. A null id is never a component's
    id, unless the component has no other. Repeated rows stay, each with its component. Other columns are ignored.
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(columns.mapInArrow(_printer(shingle), "doc_id long, print long, n_words long"))
    nodes = written(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    linked = components(links_between(nodes, bits, room))
    nodes = nodes.join(linked.select(F.col("node").alias("print"), "component"), "print", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "print"))
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = written(nodes.select("print", "copies", "component").join(least, "component"))

    total = rows.count()
    heavy = F.col("copies") * HEAVY >= F.lit(total)  # no more than HEAVY fingerprints
    by_print = nodes.select("print", "component_id", heavy.alias("heavy"))
    few = F.broadcast(by_print.where("heavy").drop("heavy"))
    rest = rows.join(few.select("print"), "print", "left_anti").join(by_print.where("not heavy").drop("heavy"), "print")
    out = rows.join(few, "print").unionByName(rest)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_words")
