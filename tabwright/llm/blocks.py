"""Documents packed into compressed blocks that several stages read without shuffling texts again.

A block holds whole documents of one input task. Blocks are written once, in buckets of their number, to the
shared scratch folder; stages send short byte strings about a block to shards and join the answers back by block.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.session import remove_path, scratch_path

BLOCK_BYTES = 16 << 20
NO_ID = np.iinfo(np.int64).max
BLOCK_FIELDS = [("block", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("text", pa.binary()), ("extra", pa.binary())]
BLOCK_SCHEMA = "block long, ids binary, lens binary, text binary, extra binary"


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeeze_array(values: np.ndarray) -> bytes:
    """Bytes of an array with those of equal weight together, which packs sorted and small numbers well."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return squeeze(np.ascontiguousarray(planes.T).tobytes())


def expand_array(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(expand(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(dtype).reshape(-1)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def gathered(table: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``table``, each from its beginning on and so long, one after another."""
    before = np.cumsum(sizes) - sizes
    return table[np.arange(sizes.sum()) + np.repeat(begins - before, sizes)]


def parts_of(batch: pa.RecordBatch, most: int, column: int = 1):
    """The rows of a batch in order, cut where a part has so many bytes of text, or more by its last row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def record(fields, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in fields], [name for name, _ in fields])


def _packer(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        made, ids, texts, extras, size = 0, [], [], [], 0

        def flush():
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            return record(
                BLOCK_FIELDS,
                block=[first + made],
                ids=[squeeze_array(np.array(ids, np.int64))],
                lens=[squeeze_array(lens)],
                text=[squeeze(b"".join(texts))],
                extra=[squeeze(b"\n".join(extras))],
            )

        for batch in batches:
            for doc_id, text, extra in zip(batch.column(0).to_pylist(), *map(text_bytes, batch.columns[1:]), strict=True):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                extras.append(extra)
                size += len(text) + 16
                if size >= block_bytes:
                    yield flush()
                    made, ids, texts, extras, size = made + 1, [], [], [], 0
        if ids:
            yield flush()

    return pack


def unpack(ids: bytes, lens: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Document ids (``NO_ID`` for null), document bounds (one more than documents) and the joined bytes."""
    lengths = expand_array(lens, np.int64)
    return expand_array(ids, np.int64), np.concatenate([[0], np.cumsum(lengths)]), expand(text)


def kept(kind: str, key, make: Callable[[], object]):
    """What ``make`` gives, kept by the worker process for its next tasks; only the last kind's and key's.

    Task functions travel by value, so that their own globals end with the task. The kept object must be bounded. What a
    stage before has kept goes first, as a worker of one stage of a pipeline is taken for the next.
    """
    store = sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker")).__dict__
    if store.get("last", (None, None, None))[:2] != (kind, key):
        store.pop("last", None)
        pa.default_memory_pool().release_unused()
        store["last"] = (kind, key, make())
    return store["last"][2]


def unused_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called that, in any case of letters."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def written(df: DataFrame) -> DataFrame:
    """A frame's rows from a table written to the shared scratch folder: computed once, lineage cut."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared scratch folder that are deleted once nothing reads them any more.

    Only delete a table when all that was derived from it is written: lost executors read it again until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "rows")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete the tables of frames that ``write`` gave; others are left alone."""
        for frame in frames:
            held = self.paths.pop(id(frame), None)
            if held is not None:
                remove_path(self.spark, held[1])

    def clear(self) -> None:
        self.drop(*[frame for frame, _ in self.paths.values()])


class Bucketed:
    """A frame in a table of the shared scratch folder, in buckets of one column: grouping by it needs no shuffle."""

    def __init__(self, df: DataFrame, column: str):
        spark = df.sparkSession
        self.name = f"blocks_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, "blocks")
        files = max(128, int(spark.conf.get("spark.sql.shuffle.partitions")))
        (
            df.write.bucketBy(files, column)
            .option("path", self.path)
            .option("compression", "none")
            .format("parquet")
            .saveAsTable(self.name)
        )
        self.table = spark.table(self.name)

    def drop(self) -> None:
        """Delete the table, once all results made from it are written."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(spark, self.path)


class Blocks(Bucketed):
    """The packed documents and how many shards suit their size.

    ``carry`` names columns to pack as one line of JSON a document, for results that keep them.
    """

    def __init__(self, docs: DataFrame, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, shard_bytes: int = 8 << 20, least_shards: int = 256):
        extra = F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])) if carry else F.lit("")
        packed = docs.select(F.col("doc_id").cast("long"), "text", extra.alias("extra")).mapInArrow(_packer(block_bytes), BLOCK_SCHEMA)
        super().__init__(packed, "block")
        self.texts = self.table.drop("extra")
        size = self.table.agg(F.sum(F.length("text"))).first()[0] or 0
        self.shards = max(least_shards, int(size // shard_bytes))

    def answer(self, replies: DataFrame, function, schema: str) -> DataFrame:
        """Each block with the replies about it; both sides are grouped by the block's number."""
        return self.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(function, schema)
