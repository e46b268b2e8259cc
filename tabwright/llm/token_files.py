"""Token ids in compressed files: one Re-Pair grammar per shard, decoded at random.

Texts are dealt by ranges of ``doc_id``, encoded and cut into shards. In a shard frequent neighbouring ids are
replaced by a nonterminal, round after round. A shard's row holds the rules, how many ids each symbol expands to,
the remaining sequence and where each document begins in it, so any document is read without the others.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwright.llm.bpe import byte_letters
from tabwright.llm.blocks import expand_array, gathered, kept, parts_of, record, squeeze_array
from tabwright.session import scratch_path

SHARD_IDS = 1 << 20
ROUNDS = 6
LEAST = 16
SLOT_BITS = 18
CACHE_WORDS = 600_000
LONG_WORD = 64  # bytes of a word whose ids are kept
PART_BYTES = 8 << 20  # of texts that are split and encoded together
# Lower-case letters, of which a word's ids need the merges alone.
NORMAL = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
LETTER, SIGN, APOSTROPHE = 1, 2, 3
KINDS = np.array([SIGN if b < 128 else 0 for b in range(256)], np.uint8)  # of a byte of a word
KINDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
KINDS[ord("'")] = APOSTROPHE
FILE = [
    ("shard", pa.int64()),
    ("first", pa.int64()),
    ("n_docs", pa.int64()),
    ("n_ids", pa.int64()),
    ("ids_of_docs", pa.binary()),
    ("symbols", pa.binary()),
    ("begins", pa.binary()),
    ("rules", pa.binary()),
    ("lengths", pa.binary()),
]
FILE_SCHEMA = ", ".join(f"{name} {'binary' if kind == pa.binary() else 'long'}" for name, kind in FILE)


def found(keys: np.ndarray, wanted: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    """Where each wanted number is among the sorted keys; of numbers that aren't there, any place.

    Keys lie in slots by a hash; those whose slot another one took are searched for by halving.
    """
    odd, shift, own = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits), np.arange(len(keys), dtype=np.int32)
    slots, slot = np.zeros(1 << bits, np.int32), keys.view(np.uint64) * odd >> shift
    slots[slot] = own
    at = slots[wanted.view(np.uint64) * odd >> shift]
    lost = np.flatnonzero(slots[slot] != own)
    if len(lost):
        rest = np.flatnonzero(keys[at] != wanted)
        at[rest] = lost[np.minimum(np.searchsorted(keys[lost], wanted[rest]), len(lost) - 1)]
    return at


def compress(ids: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, least: int = LEAST):
    """Sequence, where documents begin in it, rules (two symbols each) and expansion lengths of the rules.

    Each round counts all neighbouring pairs within documents and replaces those that occur at least ``least``
    times and an eighth as often as the most frequent one. Where replacements overlap, the more frequent pair
    goes first, then the left one. A rule's number is one above all symbols before it.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    sequence = ids.astype(np.int64)
    head = np.zeros(len(ids) + 1, bool)
    head[starts] = True
    head = head[: len(ids)]
    rules: list[np.ndarray] = []
    lengths = np.ones(base, np.int64)
    for _ in range(rounds):
        if len(sequence) < 2:
            break
        pairs = sequence[:-1] << 32 | sequence[1:]
        inner = ~head[1:]
        ordered = np.sort(pairs[inner])
        if not len(ordered):
            break
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.concatenate([cuts, [len(ordered)]]))
        top = counts.max()
        if top < least:
            break
        enough = counts >= max(least, top // 8)
        keys, weight = ordered[cuts[enough]], counts[enough]
        first_of, second_of = np.zeros(len(lengths), bool), np.zeros(len(lengths), bool)
        first_of[keys >> 32], second_of[keys & 0xFFFFFFFF] = True, True
        place = np.flatnonzero(inner & first_of[sequence[:-1]] & second_of[sequence[1:]])
        wanted = pairs[place]
        at = found(keys, wanted)
        real = keys[at] == wanted
        place, at = place[real], at[real]
        # Of a run of overlapping candidates the local tops go; equal neighbours alternate from the left.
        score = weight[at]
        touch = place[1:] == place[:-1] + 1
        here = np.ones(len(place), bool)
        here[1:] &= ~touch | (score[1:] >= score[:-1])
        here[:-1] &= ~touch | (score[:-1] >= score[1:])
        place, at = place[here], at[here]
        near = np.concatenate([[False], place[1:] == place[:-1] + 1])
        run_start = np.maximum.accumulate(np.where(near, 0, np.arange(len(place))))
        taken = (np.arange(len(place)) - run_start) % 2 == 0
        place, at = place[taken], at[taken]
        marks = np.zeros(len(keys), bool)
        marks[at] = True
        used, number = np.flatnonzero(marks), (np.cumsum(marks) - 1)[at]
        rule = np.stack([keys[used] >> 32, keys[used] & 0xFFFFFFFF], 1)
        first = len(lengths)
        rules.append(rule)
        lengths = np.concatenate([lengths, lengths[rule[:, 0]] + lengths[rule[:, 1]]])
        sequence[place] = first + number
        keep = np.ones(len(sequence), bool)
        keep[place + 1] = False
        sequence, head = sequence[keep], head[keep]
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return sequence, np.flatnonzero(head), base, rules, lengths[base:]


def expand_symbols(sequence: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    out = sequence
    while len(out) and len(rules) and out.max() >= base:
        compound = out >= base
        at = np.cumsum(1 + compound) - 1 - compound
        wide = np.empty(len(out) + int(compound.sum()), np.int64)
        wide[at[~compound]] = out[~compound]
        pair = rules[out[compound] - base]
        wide[at[compound]] = pair[:, 0]
        wide[at[compound] + 1] = pair[:, 1]
        out = wide
    return out


def expand_all(sequence: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a whole shard, each rule expanded once, and how many each symbol stands for."""
    table = np.concatenate([np.arange(base), expand_symbols(np.arange(base, base + len(rules)), base, rules, lengths)]).astype("<u4")
    sizes = np.concatenate([np.ones(base, np.int64), lengths])
    begins = np.cumsum(sizes) - sizes
    size = sizes[sequence]
    return gathered(table, begins[sequence], size), size


def words_of(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, cut at white space, and where each text's words begin and end.

    They are cut where letters and other signs of ASCII or Latin-1 meet as well, but in texts marked ``whole`` and after an
    apostrophe, which may belong to the letters behind it.
    """
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    bounds = offsets[split.offsets.to_numpy()]
    kinds = KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # two signs among the letters
    kinds[lead], kinds[lead + 1] = LETTER, LETTER
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = (kinds[:-1] == LETTER) & (kinds[1:] >= SIGN) | (kinds[:-1] == SIGN) & (kinds[1:] == LETTER)
    if whole.any():
        starts[:-1] &= ~np.repeat(whole, np.diff(bounds))
    starts[offsets] = True  # an empty word has no place of its own
    places = np.flatnonzero(starts)
    words = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
    return words, np.searchsorted(places, bounds)


class WordEncoder(dict):
    """Ids of words by the tokenizers library, each distinct word of some texts looked up once.

    The vocabulary drops white space and splits at every change between letters and other signs, so a text's ids
    are those of its words. Words in normal form already need the library's merges alone, the others all of it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge = self.library.model.tokenize
        self.normal = re.compile(NORMAL).fullmatch
        self.written = {byte: letter for letter, byte in byte_letters().items()}  # as the vocabulary writes bytes
        self.packed = [n.to_bytes(4, "little") for n in range(max(self.library.get_vocab().values()) + 1)]

    def __missing__(self, word: bytes) -> bytes:
        packed = self.packed
        if self.normal(word):
            letters = word.decode() if word.isascii() else word.decode("latin-1").translate(self.written)
            ids = b"".join([packed[t.id] for t in self.merge(letters)])
        else:
            ids = b"".join([packed[n] for n in self.library.encode(word.decode(), add_special_tokens=False).ids])
        if len(word) <= LONG_WORD:  # longer ones are rare, unless a text has no white space
            self[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; a null text has none."""
        if len(self) > CACHE_WORDS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # Added tokens are found before lower-casing, so texts that may hold one stay as they are.
        whole = pc.match_substring(texts, "<|")
        words, bounds = words_of(pc.if_else(whole, texts, pc.ascii_lower(texts)), whole.to_numpy(zero_copy_only=False))
        coded = words.dictionary_encode()
        packed = [self[w] for w in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        word = coded.indices.to_numpy()
        sizes = lengths[word]
        ids = gathered(np.frombuffer(b"".join(packed), "<u4"), (np.cumsum(lengths) - lengths)[word], sizes)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])


def _writer(path: str, end_id: int, shard_ids: int):
    def shard_row(number, docs, ids, sizes):
        sequence, begins, base, rules, lengths = compress(ids, np.cumsum(sizes) - sizes)
        return record(
            FILE,
            shard=[TaskContext.get().partitionId() << 32 | number],
            first=[base],
            n_docs=[len(docs)],
            n_ids=[len(ids)],
            ids_of_docs=[squeeze_array(np.array([-1 if d is None else d for d in docs], np.int64)) + bytes(d is None for d in docs)],
            symbols=[squeeze_array(sequence.astype("<u4"))],
            begins=[squeeze_array(begins.astype("<i8"))],
            rules=[squeeze_array(rules.reshape(-1).astype("<u4"))],
            lengths=[squeeze_array(lengths.astype("<u4"))],
        )

    def write(batches):
        encoder = kept("word encoder", path, lambda: WordEncoder(path))
        number, docs, ids, sizes, size = 0, [], [], [], 0
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                encoded, own = encoder.encode(part.column(1))
                ends = np.cumsum(own)
                encoded, own = np.insert(encoded, ends, end_id), own + 1
                ends, begin, at = np.cumsum(own), 0, 0
                # A shard ends with the document that fills it.
                while (stop := int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard_ids - size)) + 1) <= len(own):
                    docs += part.column(0)[at:stop].to_pylist()
                    yield shard_row(number, docs, np.concatenate([*ids, encoded[begin : ends[stop - 1]]]), np.concatenate([*sizes, own[at:stop]]))
                    number, docs, ids, sizes, size, begin, at = number + 1, [], [], [], 0, int(ends[stop - 1]), stop
                docs += part.column(0)[at:].to_pylist()
                ids.append(encoded[begin:])
                sizes.append(own[at:])
                size += len(encoded) - begin
        if docs:
            yield shard_row(number, docs, np.concatenate(ids), np.concatenate(sizes))

    return write


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, end it with ``end_id`` and write compressed shards, in ascending ``doc_id`` order.

    A null text is empty: the end id alone. Null ids come first; rows of one id are ordered by their text. Other
    columns are ignored. Files go to ``folder``, which the executors must share.
    """
    spark = docs.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(path, end_id, shard_ids), FILE_SCHEMA).write.option("compression", "none").parquet(folder)


def _unpack(row: dict):
    rules = expand_array(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    lengths = expand_array(row["lengths"], "<u4").astype(np.int64)
    null = np.frombuffer(row["ids_of_docs"][-row["n_docs"] :], np.uint8).astype(bool)
    doc_ids = [None if n else d for d, n in zip(expand_array(row["ids_of_docs"][: -row["n_docs"]], np.int64).tolist(), null, strict=True)]
    return expand_array(row["symbols"], "<u4").astype(np.int64), expand_array(row["begins"], "<i8"), row["first"], rules, lengths, doc_ids


def read_document(row: dict, number: int) -> np.ndarray:
    """Ids of one document of a shard's row, expanding no other."""
    symbols, begins, base, rules, lengths, _ = _unpack(row)
    stop = begins[number + 1] if number + 1 < len(begins) else len(symbols)
    return expand_symbols(symbols[begins[number] : stop], base, rules, lengths)


def _reader(with_ids: bool):
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, begins, base, rules, lengths, doc_ids = _unpack(row)
                ids, size = expand_all(symbols, base, rules, lengths)
                data = ids.tobytes()
                starts = (np.cumsum(size) - size)[begins]
                stops = np.append(starts[1:], size.sum())
                parts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "start": pa.array(starts + row["start"], pa.int64()),
                        "n_tokens": pa.array(stops - starts, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        "ids": pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                    }
                )

    return read


def read_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of written shards: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ``ids``."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    sums = files.select("shard", "n_ids").withColumn("start", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return files.join(sums.select("shard", "start"), "shard").mapInArrow(_reader(with_ids), kinds)


def through_files(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Write documents to a new folder of the shared scratch space and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_files(docs, path, folder)
    return read_files(docs.sparkSession, folder, with_ids)
