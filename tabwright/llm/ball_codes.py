"""Compression of vectors into one-byte codes per part, with codebooks learned by ball k-means.

Vectors become whole numbers and are cut into equal parts. Each part's codebook is learned by rounds over all vectors,
exactly as if every part were compared with every entry. The work is cut by balls (Xia et al. 2020): the parts of an
entry lie in a ball whose radius is the largest distance to the moved entry. Only entries with centres within twice that
radius are neighbours and can win a part over. Parts closer to their entry than half the way to its nearest neighbour
form the stable core and need no comparison; the others lie in rings, and a part of the k-th ring is compared with the
k nearest neighbours only. Distances are whole numbers, so that all comparisons are exact.

Blocks of vectors are written with their codes in each round and read in the next one; a block's balls hold its own
parts. Sums and counts of the parts of an entry are added up by task, then in one small shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import expand_array, squeeze_array
from tabwright.llm.whole_vectors import usual_length, whole_rows
from tabwright.session import remove_path, scratch_path

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMIT = 1 << 25  # size of the largest whole number a component may become: squares of 2,048 such differences fit 63 bits
EXACT = 1 << 53


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact; whole numbers below 2^53 in floating point if they fit."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * rows.shape[1] * top * top < EXACT:
        rows, entries = rows.astype(np.float64), entries.astype(np.float64)
    out = (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)
    return out.astype(np.int64)


def reassign(rows: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row and the squared distance to it, ties to the lower index, given any former codes.

    The third result counts the distances that were worked out to other entries.
    """
    between = distances(entries, entries)
    apart = rows - entries[codes]
    own = (apart * apart).sum(1)
    new, best, done = codes.copy(), own.copy(), 0
    order = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for at, end in zip(heads, [*heads[1:], len(order)], strict=True):
        members = order[at:end]
        entry = int(codes[members[0]])
        reach = 4 * own[members]  # an entry as near as the own one has its centre within twice the distance
        near = np.flatnonzero(between[entry] <= reach.max())
        near = near[near != entry]
        near = near[np.argsort(between[entry][near], kind="stable")]
        rings = np.searchsorted(between[entry][near], reach, side="right")
        outside = rings > 0  # the rest is the stable core
        if not outside.any():
            continue
        members, rings = members[outside], rings[outside]
        by_ring = np.argsort(rings, kind="stable")
        members, rings = members[by_ring], rings[by_ring]
        for some, ring in _runs(members, rings):
            # Candidates in order of index, the own entry among them, so that the first minimum is the lowest index.
            candidates = np.sort(np.append(near[:ring], entry))
            to = distances(rows[some], entries[candidates])
            pick = to.argmin(1)
            new[some], best[some] = candidates[pick], to[np.arange(len(some)), pick]
            done += to.size - len(some)
    return new, best, done


def _runs(members: np.ndarray, rings: np.ndarray):
    """Runs of members with rings of nearly one width, each with its widest ring."""
    at = 0
    while at < len(members):
        end = int(np.searchsorted(rings, rings[at] + max(8, rings[at] // 4), side="right"))
        yield members[at:end], int(rings[end - 1])
        at = end


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packer(dims: int, scale: int, parts: int):
    def run(batches):
        for batch in batches:
            at, rows = whole_rows(batch.column(1), dims, scale, LIMIT)
            if len(at):
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        _one_list(batch.column(0).take(at)),
                        _one_list(batch.column(2).take(at)),
                        pa.array([squeeze_array(rows.astype(np.int32).reshape(-1))], pa.binary()),
                        pa.array([bytes(len(rows) * parts)], pa.binary()),  # all in the first entry's ball
                    ],
                    ["ids", "labels", "rows", "codes"],
                )

    return run


def _unpacked(batch: pa.RecordBatch, at: int, dims: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    rows = expand_array(batch.column("rows")[at].as_py(), np.int32).astype(np.int64).reshape(-1, dims)
    return rows, np.frombuffer(batch.column("codes")[at].as_py(), np.uint8).reshape(-1, parts).astype(np.int64)


def _assigned(rows: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New codes of all parts and the squared distances summed over parts."""
    width = books.shape[2]
    new, error = np.empty_like(codes), np.zeros(len(rows), np.int64)
    for part, book in enumerate(books):
        new[:, part], best, _ = reassign(rows[:, part * width : (part + 1) * width], book, codes[:, part])
        error += best
    return new, error


def _round(dims: int, books: np.ndarray):
    """Blocks with new codes; the last row of a task holds its sums for the entries instead."""
    parts, size, width = books.shape
    tally_type = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("parts", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    def run(batches):
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        last = None
        for batch in batches:
            codes_out = []
            for at in range(batch.num_rows):
                rows, codes = _unpacked(batch, at, dims, parts)
                codes, _ = _assigned(rows, codes, books)
                for part in range(parts):
                    counts[part] += np.bincount(codes[:, part], minlength=size)
                    np.add.at(sums[part], codes[:, part], rows[:, part * width : (part + 1) * width])
                codes_out.append(codes.astype(np.uint8).tobytes())
            last = batch
            none = pa.nulls(batch.num_rows, tally_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes_out, pa.binary()), none], [*batch.schema.names, "tally"])
        if last is not None:
            tally = [
                {"part": int(p), "entry": int(e), "parts": int(counts[p, e]), "sums": sums[p, e].tolist()} for p, e in zip(*np.nonzero(counts), strict=True)
            ]
            empty = [pa.nulls(1, f.type) for f in last.schema]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([tally], tally_type)], [*last.schema.names, "tally"])

    return run


def _coder(dims: int, books: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                codes, error = _assigned(*_unpacked(batch, at, dims, len(books)), books)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[at].values,
                        batch.column("labels")[at].values,
                        pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()),
                        pa.array(error, pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after a round: floor of the mean of each entry's parts; entries without parts stay."""
    width = books.shape[2]
    tally = blocks.where("tally is not null").select(F.inline("tally"))
    sums = [F.sum(F.col("sums")[n]).alias(f"s{n}") for n in range(width)]
    rows = tally.groupBy("part", "entry").agg(F.sum("parts").alias("parts"), *sums).collect()  # a row per entry
    new = books.copy()
    for row in rows:
        new[row["part"], row["entry"]] = [row[f"s{n}"] // row["parts"] for n in range(width)]
    return new


def codes_and_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each usable vector, and the codebooks as an array (part, entry, component).

    ``code`` holds a byte for each part. Codebooks start as the parts of the ``entries`` smallest ids (of rows that
    share an id, the vector that is smallest component by component) and are moved ``rounds`` times. Vectors take no
    part that are null, hold null or non-finite components, become integers of ``LIMIT`` or more, or have another length
    than the most frequent one that ``parts`` divides. Rows without an id get a code but start no entry; repeated rows
    each get their code. With fewer ids the codebooks are smaller; without any id there are no entries and no codes.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index must fit one byte: entries must be 1 to 256")
    spark = vectors.sparkSession
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label)
    kind = columns.schema["label"].dataType.simpleString()
    dims = usual_length(columns, parts)
    start = _first_rows(columns, dims, scale, entries) if dims else []
    if not start:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code binary, error long"), np.zeros((parts, 0, dims // parts), np.int64)
    books = np.array(start, np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    schema = f"ids array<long>, labels array<{kind}>, rows binary, codes binary"
    tally = "tally array<struct<part int, entry int, parts long, sums array<long>>>"
    path = scratch_path(spark, "blocks")
    columns.mapInArrow(_packer(dims, scale, parts), schema).write.parquet(path)
    for _ in range(rounds):
        blocks = spark.read.schema(schema).parquet(path).where("rows is not null")
        after = scratch_path(spark, "blocks")
        blocks.mapInArrow(_round(dims, books), f"{schema}, {tally}").write.parquet(after)
        remove_path(spark, path)
        path, books = after, _moved(spark.read.schema(f"{schema}, {tally}").parquet(after), books)
    blocks = spark.read.schema(schema).parquet(path).where("rows is not null")
    return blocks.mapInArrow(_coder(dims, books), f"vec_id long, label {kind}, code binary, error long"), books


def _first_rows(columns: DataFrame, dims: int, scale: int, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids, as whole numbers: ``entries`` rows at most."""

    def usable(batches):
        for batch in batches:
            at, rows = whole_rows(batch.column(1), dims, scale, LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(rows), pa.list_(pa.int64()))], ["vec_id", "row"])

    whole = columns.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(usable, "vec_id long, row array<long>")
    ids = [r["vec_id"] for r in whole.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    columns = columns.where(F.col("vec_id").isin(ids)).select("vec_id", "embedding")
    first = columns.mapInArrow(usable, "vec_id long, row array<long>").groupBy("vec_id").agg(F.min("row").alias("row"))
    return [r["row"] for r in first.orderBy("vec_id").collect()]


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in order of part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, rows_at_once: int = 1_000_000) -> DataFrame:
    """``label_error``: the error summed over equal labels, nulls together; null where 64 bits can't hold it.

    Sums are broadcast up to ``rows_at_once`` labels. Beyond that no label has so large a share of the rows that its
    task matters, unless it is frequent: those with a thousandth of the rows or more, a thousand labels at most, are
    broadcast, the others are joined by a shuffle.
    """
    sums = coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("held"))
    facts = sums.agg(F.count("*").alias("labels"), F.sum("held").alias("rows")).first()

    def joined(rows: DataFrame, some: DataFrame) -> DataFrame:
        some = some.select(F.col("label").alias("own_label"), "label_error")
        return rows.join(some, F.col("label").eqNullSafe(F.col("own_label"))).drop("own_label")

    if facts["labels"] <= rows_at_once:
        return joined(coded, F.broadcast(sums))
    hot = sums.where(F.col("held") * 1000 >= F.lit(facts["rows"]))
    names = F.broadcast(hot.select(F.col("label").alias("hot_label")))
    rest = coded.join(names, F.col("label").eqNullSafe(F.col("hot_label")), "left_anti")
    return joined(coded, F.broadcast(hot)).unionByName(joined(rest, sums))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error and codebooks_sha256 of every usable vector."""
    coded, books = codes_and_books(vectors)
    rows = with_label_error(coded)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL that compares every part with every entry in each round."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, p, min((list_dot_product(v, v) - 2 * list_dot_product(v, entry) + list_dot_product(entry, entry))::BIGINT * 256 + e) AS best
  FROM parts JOIN b{n} USING (p) GROUP BY r, p)""")
        if n < ROUNDS:
            steps.append(f"""
s{n} AS (
  SELECT p, best % 256 AS e, i, sum(v[i]::BIGINT)::BIGINT AS total, count(*) AS held
  FROM a{n} JOIN parts USING (r, p), range(1, (SELECT max(len(v)) FROM parts) + 1) t(i) GROUP BY p, best % 256, i),
b{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(moved, entry) AS entry FROM b{n} LEFT JOIN
    (SELECT p, e, list(((total - ((total % held) + held) % held) // held)::DOUBLE ORDER BY i) AS moved FROM s{n} GROUP BY p, e) USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
parts AS MATERIALIZED (SELECT r, p, list_slice(x, (p * len(x) // 4 + 1)::BIGINT, ((p + 1) * len(x) // 4)::BIGINT) AS v FROM kept, range(4) t(p)),
first AS (SELECT vec_id, min(r) AS r FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS entry FROM first JOIN parts USING (r)),
{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(entry) AS c, generate_subscripts(entry, 1) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""


CODES_SQL = _oracle()
