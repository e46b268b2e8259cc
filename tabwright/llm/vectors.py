"""Vectors dealt to shards, equal ones together, and queries dealt to them in blocks."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 4096
QUERY_BLOCK = 4096
PACK = 512


def parsed(batch: pa.RecordBatch):
    """Id and components, as float64, of every row whose vector is whole and finite."""
    for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if vec_id is None or not vector.is_valid:
            continue
        values = vector.values
        if values.null_count or not len(values):
            continue
        values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(values).all():
            yield vec_id, values


def _dealer(shards: int, usable, keep: int):
    def deal(batches):
        classes: dict[bytes, list[int]] = {}

        def rows():
            codes = list(classes)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([xxhash.xxh64_intdigest(c) % shards for c in codes], pa.int32()),
                    "vector": pa.array(codes, pa.binary()),
                    "ids": pa.array([sorted(set(classes[c]))[:keep] for c in codes], pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            for vec_id, values in parsed(batch):
                if usable(values):
                    own = classes.setdefault((values + 0.0).tobytes(), [])
                    own.append(vec_id)
                    if len(own) > 64:
                        own[:] = sorted(set(own))[:keep]
            if len(classes) > 100_000:
                yield rows()
                classes.clear()
        if classes:
            yield rows()

    return deal


def deal_classes(vectors: DataFrame, shards: int, usable, keep: int) -> DataFrame:
    """Distinct vectors by shard, with the ``keep`` smallest ids of each within a task.

    No result of fewer than ``keep`` rows can need more ids of one vector.
    """
    columns = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return columns.mapInArrow(_dealer(shards, usable, keep), "shard int, vector binary, ids array<long>")


def merge_classes(table, keep: int):
    """Matrices by dimension and, for each row, its ids, from the rows of one shard."""
    classes: dict[bytes, set[int]] = {}
    for code, ids in zip(table.column("vector").to_pylist(), table.column("ids").to_pylist(), strict=True):
        classes.setdefault(code, set()).update(ids)
    by_size: dict[int, list[bytes]] = {}
    for code in sorted(classes):
        by_size.setdefault(len(code) // 8, []).append(code)
    for size, codes in by_size.items():
        yield size, np.frombuffer(b"".join(codes)).reshape(len(codes), size), [sorted(classes[c])[:keep] for c in codes]


def _query_packer(usable, modulus: int):
    def pack(batches):
        ids, codes = [], []

        def row():
            return pa.RecordBatch.from_pydict({"queries": pa.array([pickle.dumps((ids, codes))], pa.binary())})

        for batch in batches:
            for vec_id, values in parsed(batch):
                if vec_id % modulus == 0 and usable(values):
                    ids.append(vec_id)
                    codes.append((values + 0.0).tobytes())
                    if len(ids) == PACK:
                        yield row()
                        ids, codes = [], []
        if ids:
            yield row()

    return pack


def search(vectors: DataFrame, build, find, usable, modulus: int, top: int) -> DataFrame:
    """Each query's ``top`` results: query_id, rank, vec_id, score.

    ``build(size, matrix)`` makes the index of a shard, ``find(index, matrix, ids, query_ids, queries)`` yields
    (query_id, vec_id, score) from it. Each block of queries meets each shard's index once; shards grow in number
    with the rows and blocks with the queries, so neither grows in size.
    """
    count = vectors.count()
    shards = max(8, -(-count // SHARD_ROWS))
    keep = top + 1
    wanted = vectors.where(F.col("vec_id") % modulus == 0)
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))

    def make(key, table):
        packed = [(size, matrix, ids, build(matrix)) for size, matrix, ids in merge_classes(table, keep)]
        return pa.table({"shard": table.column("shard")[:1], "index": pa.array([pickle.dumps(packed)], pa.binary())})

    def answer(left, right):
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            packs = [pickle.loads(p) for p in right.column("queries").to_pylist()]
            for size, matrix, ids, index in pickle.loads(left.column("index")[0].as_py()):
                chosen = [(q, c) for own, codes in packs for q, c in zip(own, codes, strict=True) if len(c) == 8 * size]
                if chosen:
                    queries = np.frombuffer(b"".join(c for _, c in chosen)).reshape(len(chosen), size)
                    for found in find(index, matrix, ids, [q for q, _ in chosen], queries):
                        for column, value in zip(out, found, strict=True):
                            column.append(value)
        score = pa.int64() if kind == "long" else pa.float64()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], score)})

    kind = find.score
    index = deal_classes(vectors, shards, usable, keep).groupBy("shard").applyInArrow(make, "shard int, index binary")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = wanted.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    packs = columns.mapInArrow(_query_packer(usable, modulus), "queries binary")
    packs = packs.withColumn("part", F.pmod(F.xxhash64("queries"), F.lit(blocks)).cast("int"))
    packs = packs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = index.groupBy("shard", "part").cogroup(packs.groupBy("shard", "part")).applyInArrow(answer, f"query_id long, vec_id long, score {kind}")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
