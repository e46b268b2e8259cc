"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two windows of ``depth`` bytes are equal if their suffixes agree through ``depth`` bytes, so suffixes are ordered
only that far, by most-significant-digit passes that leave out every suffix that stands alone.

1. The first digit of a window is the ``DIGIT`` bytes in it that hash lowest. Equal windows have the same first
   digit at the same place, and neighbouring windows mostly share it: such a run of windows is sent as one string.
2. First pass: blocks send the hashes of their first digits to shards, once per block. A digit that occurs in one
   document only leaves.
3. Further passes: shards receive the runs that are left and refine groups by eight bytes at a time, first whole
   runs, then the single windows of the distinct runs. Groups left at full depth are exactly the repeated windows;
   hashes only choose what is compared.
4. Blocks receive the intervals to remove.

A hot passage is sent to a shard once per document that holds it and is compared as one distinct run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.blocks import NO_ID, Blocks, expand, expand_array, record, squeeze, squeeze_array, unpack

DEPTH = 50
DIGIT = 20
SLICE = 1 << 16

SENT = [("shard", pa.int32()), ("block", pa.int64()), ("digits", pa.binary())]
LEFT = [("block", pa.int64()), ("shard", pa.int32()), ("left", pa.binary())]
RUNS = [(k, pa.int32() if k == "shard" else pa.int64() if k == "block" else pa.binary()) for k in ("shard", "block", "keys", "docs", "starts", "counts", "text")]
CUTS = [("block", pa.int64()), ("starts", pa.binary()), ("stops", pa.binary())]
RESULT = [
    ("doc_id", pa.int64()),
    ("n_bytes", pa.int64()),
    ("n_removed", pa.int64()),
    ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()),
    ("kept", pa.string()),
    ("extra", pa.string()),
]


def _words(buffer: bytes, start: int, count: int) -> np.ndarray:
    """The eight bytes at each of ``count`` positions, as numbers."""
    return np.ndarray((count,), np.uint64, buffer, start, (1,))


def _digit_hashes(buffer: bytes, start: int, count: int, digit: int) -> np.ndarray:
    hashes = _words(buffer, start, count) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, digit, 8):
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes += _words(buffer, start + min(at, digit - 8), count)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x94D049BB133111EB)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def window_runs(text: bytes, bounds: np.ndarray, depth: int = DEPTH, digit: int = DIGIT):
    """Runs of neighbouring windows with one first digit: start, number of windows, hash of the digit, document."""
    size = len(text)
    buffer = text + bytes(depth + 64)
    width = depth - digit + 1
    low = np.uint64((SLICE << 1) - 1)
    starts, keys = [], []
    for at in range(0, size, SLICE):
        count = min(SLICE, size - at)
        hashes = _digit_hashes(buffer, at, count + width - 1, digit)
        lowest = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            lowest = np.minimum(lowest[:-step], lowest[step:])
            span += step
        fresh = np.flatnonzero(lowest[1:] != lowest[:-1]) + 1
        fresh = np.concatenate([[0], fresh])
        starts.append(fresh + at)
        keys.append(hashes[(lowest[fresh] & low).astype(np.int64)])
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    starts, keys = np.concatenate(starts), np.concatenate(keys)
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)  # lowest hashes are small: spread them again
    keys ^= keys >> np.uint64(32)
    begin, end = bounds[:-1], bounds[1:] - depth + 1  # windows of a document start in [begin, end)
    has = end > begin
    edges = np.setdiff1d(np.concatenate([begin[has], end[has]]), starts)
    edges = edges[edges < size]
    from_run = np.searchsorted(starts, edges, "right") - 1
    starts, keys = np.concatenate([starts, edges]), np.concatenate([keys, keys[from_run]])
    order = np.argsort(starts, kind="stable")
    starts, keys = starts[order], keys[order]
    counts = np.diff(np.concatenate([starts, [size]]))
    doc = np.searchsorted(bounds, starts, "right") - 1
    inside = starts < bounds[doc + 1] - depth + 1
    return starts[inside], counts[inside], keys[inside], doc[inside]


def refine(groups: np.ndarray, buffer: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the group of equal strings each string is in, -1 if it stands alone; ``groups``: known so far.

    Most significant digits first, eight bytes a pass; strings of a group must have one length of eight or more.
    """
    final = np.full(len(starts), -1, np.int64)
    active = np.arange(len(starts))
    current = groups.astype(np.uint64)
    made, depth = 0, 0
    while len(active):
        words = np.ndarray((len(buffer) - 7,), np.uint64, buffer, 0, (1,))
        reach = np.minimum(depth, lengths[active] - 8)
        digits = words[starts[active] + reach]
        order = np.lexsort((digits, current))
        active, current, digits = active[order], current[order], digits[order]
        fresh = np.ones(len(active), bool)
        fresh[1:] = (current[1:] != current[:-1]) | (digits[1:] != digits[:-1])
        number = np.cumsum(fresh) - 1
        several = np.bincount(number)[number] > 1
        depth += 8
        done = several & (lengths[active] <= depth)
        final[active[done]] = number[done] + made
        made += int(number[-1]) + 1
        keep = several & ~done
        active, current = active[keep], number[keep].astype(np.uint64)
    return final


def _first_pass(shards: int, depth: int, digit: int):
    def send(batches):
        for batch in batches:
            for block, ids, lens, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, bounds, joined = unpack(ids, lens, text)
                _, _, keys, doc = window_runs(joined, bounds, depth, digit)
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], ids[doc[order]]
                heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                several = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
                keys = keys[heads]
                shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)  # ascending with the key
                cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                short = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out = {"shard": [], "block": [], "digits": []}
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        out["shard"].append(s)
                        out["block"].append(block)
                        out["digits"].append(short[a:b].tobytes() + np.packbits(several[a:b]).tobytes())
                yield record(SENT, **out)

    return send


def _split_digits(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = len(data) * 8 // 33
    return np.frombuffer(data, np.uint32, count), np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * count), count=count)


def _left(key, table):
    """Which digits of each block occur in more documents than one."""
    parts = [_split_digits(d) for d in table.column("digits").to_pylist()]
    digits = np.concatenate([p[0] for p in parts])
    several = np.concatenate([p[1] for p in parts])
    # Equal numbers in one block may be different digits: then both stay, which costs a comparison.
    values, inverse, counts = np.unique(digits, return_inverse=True, return_counts=True)
    stay = (counts > 1) | (np.bincount(inverse, several, len(values)) > 0)
    flags = stay[inverse]
    cuts = np.cumsum([len(p[0]) for p in parts])
    left = [np.packbits(f).tobytes() for f in np.split(flags, cuts[:-1])]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "left": pa.array(left, pa.binary())})


def _gather(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many pieces, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint8)
    offsets = np.cumsum(lengths) - lengths
    index = np.ones(total, np.int64)
    index[0] = starts[0]
    index[offsets[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return text[np.cumsum(index)]


def _second_pass(shards: int, depth: int, digit: int):
    def send(blocks, replies):
        out = {name: [] for name, _ in RUNS}
        if blocks.num_rows and replies.num_rows:
            block, ids, lens, text = (c[0] for c in blocks.select(["block", "ids", "lens", "text"]).to_pydict().values())
            ids, bounds, joined = unpack(ids, lens, text)
            starts, counts, keys, doc = window_runs(joined, bounds, depth, digit)
            known = np.unique(keys)
            shard = (((known >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            left = np.zeros(len(known), bool)
            for s, flags in zip(replies.column("shard").to_pylist(), replies.column("left").to_pylist(), strict=True):
                a, b = cuts[s], cuts[s + 1]
                left[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a)
            at = np.searchsorted(known, keys)
            keep = left[at]
            starts, counts, keys, doc, shard = starts[keep], counts[keep], keys[keep], doc[keep], shard[at[keep]]
            order = np.argsort(shard, kind="stable")
            starts, counts, keys, doc, shard = starts[order], counts[order], keys[order], doc[order], shard[order]
            raw = np.frombuffer(joined, np.uint8)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for s in range(shards):
                part = slice(cuts[s], cuts[s + 1])
                if cuts[s] < cuts[s + 1]:
                    out["shard"].append(s)
                    out["block"].append(block)
                    out["keys"].append(keys[part].tobytes())
                    out["docs"].append(squeeze_array(ids[doc[part]]))
                    out["starts"].append(squeeze_array(starts[part].astype(np.int64)))
                    out["counts"].append(squeeze_array(counts[part].astype(np.uint16)))
                    out["text"].append(squeeze(_gather(raw, starts[part], counts[part] + depth - 1).tobytes()))
        return pa.table({name: pa.array(out[name], kind) for name, kind in RUNS})

    return send


def _compare(depth: int):
    """Intervals to remove, from all runs of one shard."""

    def compare(key, table):
        columns = table.to_pydict()
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in columns["keys"]])
        docs = np.concatenate([expand_array(d, np.int64) for d in columns["docs"]])
        starts = np.concatenate([expand_array(d, np.int64) for d in columns["starts"]])
        sizes = [len(k) // 8 for k in columns["keys"]]
        counts = np.concatenate([expand_array(d, np.uint16) for d in columns["counts"]]).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        text = b"".join(map(expand, columns["text"])) + bytes(8)
        lengths = counts + depth - 1
        at = np.cumsum(lengths) - lengths

        # Whole runs. The digit and the length are known, so a group starts with them.
        _, group = np.unique(keys, return_inverse=True)
        run = refine(group.astype(np.int64) * 64 + counts, text, at, lengths)
        alone = run < 0
        run[alone] = (run.max() + 1 if len(run) else 0) + np.arange(alone.sum())
        _, heads, run = np.unique(run, return_index=True, return_inverse=True)
        first = np.full(len(heads), NO_ID, np.int64)
        np.minimum.at(first, run, docs)
        whole = docs > first[run]

        # Windows of the distinct runs of a digit that has several.
        run_group = group[heads]
        several = np.bincount(run_group)[run_group] > 1
        chosen = np.flatnonzero(several)
        number = counts[heads[chosen]]
        window_run = np.repeat(chosen, number)
        offset = np.arange(len(window_run)) - np.repeat(np.cumsum(number) - number, number)
        window_at = at[heads[window_run]] + offset
        found = refine(run_group[window_run], text, window_at, np.full(len(window_at), depth))
        least = np.full(int(found.max()) + 1 if len(found) and found.max() >= 0 else 0, NO_ID, np.int64)
        hit = found >= 0
        np.minimum.at(least, found[hit], first[window_run[hit]])
        hit[hit] = least[found[hit]] < first[window_run[hit]]

        # A run in its first document loses the windows found earlier elsewhere.
        head_start = np.full(len(heads), -1, np.int64)
        head_start[chosen] = np.cumsum(number) - number
        rest = np.flatnonzero(~whole & (head_start[run] >= 0))
        n = counts[rest]
        which = np.repeat(rest, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        lost = hit[head_start[run[which]] + step]
        edge = np.diff(np.concatenate([[0], lost.astype(np.int8)]))
        new_run = step == 0
        begin = lost & ((edge == 1) | new_run)
        last = np.concatenate([new_run[1:], [True]]) if len(which) else np.zeros(0, bool)
        stop = lost & (last | np.concatenate([~lost[1:], [True]])) if len(which) else lost
        lo = np.concatenate([starts[whole], starts[which[begin]] + step[begin]])
        hi = np.concatenate([starts[whole] + counts[whole], starts[which[stop]] + step[stop] + 1]) + depth - 1
        of = np.concatenate([owner[whole], owner[which[begin]]])
        order = np.lexsort((lo, of))
        lo, hi, of = lo[order], hi[order], of[order]
        if len(lo):  # touching intervals of a block become one
            top = np.maximum.accumulate(hi + of * (1 << 40)) - of * (1 << 40)
            fresh = np.ones(len(lo), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (lo[1:] > top[:-1])
            first_of = np.flatnonzero(fresh)
            lo, of = lo[first_of], of[first_of]
            hi = top[np.concatenate([first_of[1:], [len(top)]]) - 1]
        out = {"block": [], "starts": [], "stops": []}
        for i, block in enumerate(columns["block"]):
            a, b = np.searchsorted(of, [i, i + 1])
            if a < b:
                out["block"].append(block)
                out["starts"].append(squeeze_array(lo[a:b]))
                out["stops"].append(squeeze_array(hi[a:b]))
        return pa.table({name: pa.array(out[name], kind) for name, kind in CUTS})

    return compare


def _finish(with_text: bool):
    def finish(blocks, cuts):
        out = {name: [] for name, _ in RESULT}
        if blocks.num_rows:
            ids, bounds, joined = unpack(*(c[0] for c in blocks.select(["ids", "lens", "text"]).to_pydict().values()))
            extras = expand(blocks.column("extra")[0].as_py()).decode().split("\n")
            change = np.zeros(len(joined) + 1, np.int32)
            for starts, stops in zip(cuts.column("starts").to_pylist(), cuts.column("stops").to_pylist(), strict=True):
                np.add.at(change, expand_array(starts, np.int64), 1)
                np.add.at(change, expand_array(stops, np.int64), -1)
            gone = np.cumsum(change[:-1], out=change[:-1]) > 0
            raw = np.frombuffer(joined, np.uint8)
            for i, doc_id in enumerate(ids.tolist()):
                a, b = int(bounds[i]), int(bounds[i + 1])
                mask = gone[a:b]
                removed = int(np.count_nonzero(mask))
                kept = joined[a:b] if not removed else raw[a:b][~mask].tobytes()
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if removed else 0
                out["doc_id"].append(None if doc_id == NO_ID else doc_id)
                out["n_bytes"].append(b - a)
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
                out["extra"].append(extras[i] if with_text else None)
        return pa.table({name: pa.array(out[name], kind) for name, kind in RESULT})

    return finish


def remove_repeats(docs: DataFrame, depth: int = DEPTH, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per document the bytes left once all bytes in a repeated window are removed.

    A window is ``depth`` (at least 24) bytes; it is repeated if it also starts in a document with a smaller
    ``doc_id``. Windows lie within a document, overlaps count, and repeats are judged on the input. Columns:
    doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, null unless ``with_text``, ``kept`` (the text left, without
    parts of characters) and ``extra`` (the columns to ``carry``, as JSON).

    A null text is empty. A null ``doc_id`` counts as larger than any other. Rows of one ``doc_id`` don't repeat
    each other, but each loses what smaller ids hold. Other columns are ignored; an empty table gives an empty one.
    """
    if depth < DIGIT + 4:
        raise ValueError("depth must be at least 24")
    blocks = Blocks(docs, carry if with_text else None)
    send = blocks.texts.mapInArrow(_first_pass(blocks.shards, depth, DIGIT), "shard int, block long, digits binary")
    left = send.groupBy("shard").applyInArrow(_left, "block long, shard int, left binary")
    kinds = ", ".join(f"{name} {'int' if name == 'shard' else 'long' if name == 'block' else 'binary'}" for name, _ in RUNS)
    runs = blocks.answer(left, _second_pass(blocks.shards, depth, DIGIT), kinds)
    cuts = runs.groupBy("shard").applyInArrow(_compare(depth), "block long, starts binary, stops binary")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, extra string"
    return blocks.answer(cuts, _finish(with_text), kinds)
