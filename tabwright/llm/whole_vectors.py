"""Vectors of one length as whole numbers: what whitening and code compression start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(vectors: DataFrame, multiple: int = 1) -> int:
    """The most frequent length that is a multiple of ``multiple``, the longer one on a tie; 0 without vectors."""
    sizes = vectors.select(F.size("embedding").alias("size")).where(F.col("size") > 0).where(F.col("size") % multiple == 0)
    top = sizes.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def whole_rows(column: pa.Array, dims: int, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and floor(scale * component) as a matrix of 64-bit integers.

    Null vectors, vectors of other lengths, with null or non-finite components or with integers of ``limit`` or more
    in size are left out.
    """
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    scaled = np.floor(scale * flat.reshape(len(at), dims))
    good = (np.abs(scaled) < limit).all(1)  # false for NaN
    return at[good], scaled[good].astype(np.int64)


def packed(row: np.ndarray) -> bytes:
    """A vector's bytes in the narrowest type that holds it; equal vectors give equal bytes."""
    top = int(np.abs(row).max())
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return row.astype(kind).tobytes()


def unpacked(codes: Iterator[bytes], dims: int) -> np.ndarray:
    """The matrix of packed vectors of ``dims`` components."""
    kinds = {2 * dims: np.int16, 4 * dims: np.int32, 8 * dims: np.int64}
    return np.stack([np.frombuffer(c, kinds[len(c)]).astype(np.int64) for c in codes])
