"""Own encoding, decoding and token files against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabwright.llm.bpe import PairIndexEncoder, encode_decode, newer_signs
from tabwright.llm.queries import QUERIES, vocabulary
from tabwright.llm.token_files import FILE_SCHEMA, WordEncoder, compress, expand_symbols, read_document, read_files, through_files, write_files

SCHEMA = "doc_id long, text string, ids string, start int"
ODD = [None, "", " ", "<|endoftext|>", "A<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>x", "aaaa" * 300, "\n\n\t  x \x01 y\x01z", "the., a,b 3.14 vié, vié.́ x", "été É ǅ İ", "x" * 200_000]


def rows():
    rng = random.Random(2)
    letters = "abcdeéß.,;'! 0189\n\t漢🎉<|>"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(80)] + ["It's the end, isn't it? " * 40] * 5
    out = [(n * 7 % 97, t, "x", 0) for n, t in enumerate(texts)]
    return out + [out[50], (None, "no id", "x", 1)]


def test_bpe_equals_the_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = []
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), back.encode())]
        expected.append((doc_id, len(ids), *sha))
    out = encode_decode(spark.createDataFrame(rows(), SCHEMA).repartition(3), path)
    assert sorted((tuple(r) for r in out.drop("ids", "decoded").collect()), key=str) == sorted(expected, key=str)


def test_words_split_as_the_library_does():
    """Also letters and numbers that are newer than the library: all of these, and every seventh code point."""
    path, newer = vocabulary("byte_bpe_50k.json"), newer_signs()
    library, encoder = Tokenizer.from_file(path), PairIndexEncoder(path, newer)
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 7 == 0 or encoder.newer.match(chr(c)))]
    assert "\\U00000558" in newer and len(odd) > 160_000
    texts = ["".join(f"a{chr(c)}'s 1{chr(c)} {chr(c)}.{chr(c)}" for c in odd[at : at + 500]) for at in range(0, len(odd), 500)]
    texts += ["a\u0558's", "x \ua7ce\u0558 it's", "\U00010940" * 5, "old text only, it's fine"]
    for text, ids in zip(texts, encoder.encode(texts, {}), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_are_not_kept():
    encoder, cache = PairIndexEncoder(vocabulary("byte_bpe_50k.json")), {}
    text = "x" * 300_000 + " short " + "y" * 65
    assert encoder.decode(encoder.encode([text], cache)[0]).decode() == text
    assert encoder.encode([text], cache) == encoder.encode([text], {}) and max(map(len, cache)) <= 64


def test_a_part_holds_each_distinct_word_once():
    encoder = PairIndexEncoder(vocabulary("byte_bpe_50k.json"))
    text = "some words that come again and again " * 110  # of 8 MB of them no list of words is made
    tracemalloc.start()
    ids = encoder.encode((text for _ in range(2000)), {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 2000 and len(set(ids)) == 1 and peak < 16 * len(text) * 2000 // 5


def test_decode_shows_broken_characters():
    encoder = PairIndexEncoder(vocabulary("byte_bpe_50k.json"))
    half = encoder.encode(["é"], {})[0]
    byte_id = encoder.tokens.index(b"\xc3").to_bytes(4, "little")
    assert encoder.decode(half) == "é".encode() and encoder.decode(byte_id).decode("utf-8", "replace") == "�"


@pytest.mark.parametrize("parts", [1, 4])
def test_token_files_equal_the_library(spark, tmp_path, parts):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoded = []
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        encoded.append((doc_id is not None, doc_id or 0, text or "", doc_id, ids))
    start, expected = 0, []
    for *_, doc_id, ids in sorted(encoded, key=lambda e: e[:3]):
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = str(tmp_path / "files")
    write_files(spark.createDataFrame(rows(), SCHEMA).repartition(parts), path, folder, shard_ids=3000)
    out = [tuple(r) for r in read_files(spark, folder).drop("ids").orderBy("start").collect()]
    assert out == expected
    stored = spark.read.schema(FILE_SCHEMA).parquet(folder).orderBy("shard").collect()
    assert len(stored) > 1
    one = stored[1].asDict()
    ids = [read_document(one, n) for n in range(one["n_docs"])]
    skip = stored[0].n_docs
    assert [zlib.crc32(i.astype("<u4").tobytes()) for i in ids] == [e[3] for e in expected[skip : skip + len(ids)]]


def test_words_cut_at_signs_are_the_library_s():
    path = vocabulary("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), WordEncoder(path)
    rng = random.Random(4)
    signs = [*"abzAZ019'\"!.,<>|=_-", "'s", "'re", "'LL", "é", "É", "ß", "×", "÷", "ÿ", "\u0301", "\u0338", "\u0345", "Σ", "ς", "ж", "漢", "🎉", " ", "\n", "\x1c", "\x85", "\xa0", "\u200b", "İ", "ǅ", "½", "٣"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "x<|endoftext|>'s a.<|startoftext|>", "<|ENDOFTEXT|>b.c", "don't,'tis 'twas!'re..."]
    for part in (texts, texts[::-1], [t for t in texts if t and "<|" in t], [None, ""], []):
        ids, sizes = encoder.encode(pa.array(part, pa.string()))
        expected = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_each_distinct_word_is_looked_up_once():
    class Counted(WordEncoder):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    encoder = Counted(vocabulary("word_bpe_49k.json"))
    ids, sizes = encoder.encode(pa.array(["the end, the end. " * 50] * 200, pa.string()))
    assert sizes.tolist() == [300] * 200 and len(ids) == 60_000
    assert encoder.asked == 4
    encoder.encode(pa.array(["x" * 300_000], pa.string()))
    assert max(map(len, encoder)) <= 64


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert encode_decode(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert through_files(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_grammar_round_trip_and_gain():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 7), 300), np.zeros(501, np.int64), rng.integers(0, 9, 3000)])
    starts = np.unique(np.concatenate([[0], rng.integers(0, len(ids), 40)]))
    sequence, begins, base, rules, lengths = compress(ids, starts)
    assert (expand_symbols(sequence, base, rules, lengths) == ids).all()
    assert len(sequence) < 0.8 * len(ids) and len(begins) == len(starts)
    size = np.where(sequence >= base, np.concatenate([lengths, [0]])[np.maximum(sequence - base, 0)], 1)
    assert ((np.cumsum(size) - size)[begins] == starts).all()


def test_queries_on_small_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert QUERIES["op2_bpe"](spark, small_dir).count() == docs
    assert QUERIES["op10_token_files"](spark, small_dir).count() == docs
