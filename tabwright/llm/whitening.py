"""Whitening of embeddings by spectral divide and conquer.

The covariance of the distinct vectors is summed by the tasks; it has one row per dimension, so that the driver can
hold it however many vectors there are. There its eigenvectors are found without an eigenvalue routine: the orthogonal
polar factor U of the shifted covariance, by dynamically weighted Halley steps (QDWH; Nakatsukasa and Higham 2013), gives
the projector (U + I) / 2 onto the eigenvectors above the shift. The covariance is split into the parts on that subspace
and on its complement, and these are split on until one dimension is left or all eigenvalues of a part are equal. The
projection is sent to the tasks, which whiten every vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.blocks import written
from tabwright.llm.whole_vectors import packed, unpacked, usual_length, whole_rows

SCALE = 256
COMPONENTS = 4
LIMIT = 1 << 40  # size of the largest whole number a component may become
EPS = float(np.finfo(np.float64).eps)
HELD = 50_000  # distinct vectors a task holds before it sends them on


def polar(matrix: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: the sign of each eigenvalue on its eigenvectors."""
    size = np.linalg.norm(matrix)
    x, eye = matrix / size, np.eye(len(matrix))
    low = EPS  # at most the least singular value, unless that is zero to working precision
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            new = b / c * x + (a - b / c) / np.sqrt(c) * q[: len(x)] @ q[len(x) :].T
        else:
            new = b / c * x + (a - b / c) * np.linalg.solve(eye + c * x.T @ x, x.T).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (a + b * square) / (1 + c * square))
        if 1 - low < 10 * EPS and moved < 1e-8:  # convergence is cubic
            break
    return x


def _split(matrix: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below the shift; None if it doesn't part them well."""
    size = len(matrix)
    projector = (polar(matrix - shift * np.eye(size)) + np.eye(size)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < size or np.linalg.norm(projector @ projector - projector) > 1e-9 * size:
        return None
    q = np.random.default_rng(size).normal(size=(size, size))
    for _ in range(2):  # the second time mends an unlucky start
        q, _ = np.linalg.qr(projector @ q[:, :rank])
        q, _ = np.linalg.qr(np.hstack([q, np.random.default_rng(rank).normal(size=(size, size - rank))]))
    left_out = np.abs(q[:, rank:].T @ matrix @ q[:, :rank]).max()
    return (q[:, :rank], q[:, rank:]) if left_out <= 1e-12 * np.linalg.norm(matrix) * size else None


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix."""
    whole = np.linalg.norm(matrix)

    def divide(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, middle = len(part), float(np.trace(part)) / len(part)
        spread = np.linalg.norm(part - middle * np.eye(size))
        if size == 1 or spread <= 4 * EPS * whole:
            return np.full(size, middle), np.eye(size)
        # The median parts evenly; the mean lies between the least and the largest eigenvalue. If a shift is an
        # eigenvalue, one beside it is not.
        steps = [0.0] + [sign * spread * 0.37 / size * n for n in range(1, 40) for sign in (1, -1)]
        for shift in (base + step for step in steps for base in (float(np.median(np.diag(part))), middle)):
            bases = _split(part, shift)
            if bases:
                found = [divide((lambda m: (m + m.T) / 2)(basis.T @ part @ basis)) for basis in bases]
                return np.concatenate([v for v, _ in found]), np.hstack([b @ q for b, (_, q) in zip(bases, found, strict=True)])
        return np.full(size, middle), np.eye(size)  # eigenvalues that no shift tells apart

    values, vectors = divide((matrix + matrix.T) / 2)
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """What is learned from the distinct vectors: their number, sums, and the leading components.

    ``projection`` has one row per component, scaled by one over the root of its eigenvalue; a component without
    spread has no row but a place in ``values``. ``trace`` is the sum of all variances, ``identity_error`` how far the
    covariance of the whitened distinct vectors is from the identity (None without components).
    """

    dims: int
    count: int
    sums: tuple[int, ...]
    values: tuple[float, ...] = ()
    projection: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float | None = None

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """Rows less the mean; the whole part of the mean goes first, without rounding."""
        whole = [s // self.count for s in self.sums]
        rest = np.array([(s - w * self.count) / self.count for s, w in zip(self.sums, whole, strict=True)])
        return (rows - np.array(whole, np.int64)).astype(np.float64) - rest

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (count * x - sum)^2; None where a 64-bit integer can't hold it."""
        if not len(rows):
            return []
        sums = np.array(self.sums, object)
        most = self.count * int(np.abs(rows).max()) + max(abs(s) for s in self.sums)
        if most * most * self.dims < 1 << 62:
            apart = self.count * rows - sums.astype(np.int64)
            return (apart * apart).sum(1).tolist()
        exact = (((self.count * rows.astype(object) - sums) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _distinct_in_task(dims: int, scale: int):
    def run(batches):
        seen: set[bytes] = set()

        def rows():
            return pa.RecordBatch.from_pydict({"x": pa.array(list(seen), pa.binary())})

        for batch in batches:
            seen.update(map(packed, whole_rows(batch.column(0), dims, scale, LIMIT)[1]))
            if len(seen) > HELD:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return run


def _task_sums(dims: int):
    def run(batches):
        count, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                rows = unpacked(batch.column(0).to_pylist(), dims)
                count += len(rows)
                sums = [a + b for a, b in zip(sums, rows.sum(0).tolist(), strict=True)]
        if count:
            yield pa.RecordBatch.from_pydict({"count": pa.array([count], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})

    return run


def _task_products(dims: int, project):
    """One row per dimension of the products of projected vectors, summed over the task."""

    def run(batches):
        total, task = None, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                rows = project(unpacked(batch.column(0).to_pylist(), dims))
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            size = len(total)
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array(range(size), pa.int32()),
                    "task": pa.array([task] * size, pa.int32()),
                    "products": pa.array(list(total), pa.list_(pa.float64())),
                }
            )

    return run


def _merge(key, table):
    """The tasks' rows of one dimension added in the order of the tasks, so that runs agree."""
    table = table.sort_by("task")
    total = np.stack(table.column("products").to_pylist()).cumsum(0)[-1]
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "products": pa.array([total], pa.list_(pa.float64()))})


def _covariance(distinct: DataFrame, whitening: Whitening, project) -> np.ndarray:
    products = distinct.mapInArrow(_task_products(whitening.dims, project), "dim int, task int, products array<double>")
    merged = products.groupBy("dim").applyInArrow(_merge, "dim int, products array<double>")
    rows = sorted((r["dim"], r["products"]) for r in merged.collect())  # one row per dimension
    return np.array([r for _, r in rows]) / whitening.count


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Components of ``floor(scale * embedding)`` over its distinct values; None without usable vectors.

    Vectors take no part that are null, hold null or non-finite entries, become integers of ``LIMIT`` or more, or have
    another length than most vectors. There are as many components as dimensions at most.
    """
    dims = usual_length(vectors)
    if not dims:
        return None
    columns = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    distinct = written(columns.mapInArrow(_distinct_in_task(dims, scale), "x binary").distinct())
    exact = distinct.mapInArrow(_task_sums(dims), "count long, sums array<string>")
    exact = exact.select("count", F.posexplode("sums").alias("dim", "part"))
    exact = exact.groupBy("dim").agg(F.sum("count").alias("count"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"))
    facts = sorted(exact.collect())  # one row per dimension
    if not facts:
        return None
    start = Whitening(dims, facts[0]["count"], tuple(int(r["sum"]) for r in facts))
    covariance = _covariance(distinct, start, start.centred)
    values, basis = eigen(covariance)
    trace = float(np.trace(covariance))
    used = values[: min(components, dims)]
    spread = used > dims * EPS * max(values[0], 0.0)
    projection = (basis[:, : len(used)][:, spread] / np.sqrt(used[spread])).T
    error = None
    if len(projection):
        found = _covariance(distinct, start, lambda rows: start.centred(rows) @ projection.T)
        error = float(np.abs(found - np.eye(len(projection))).max())
    return Whitening(dims, start.count, start.sums, tuple(np.maximum(used, 0.0).tolist()), projection, trace, error)


def _whitener(fitted: Whitening, scale: int):
    explained = [value / fitted.trace if fitted.trace else None for value in fitted.values]

    def run(batches):
        for batch in batches:
            at, rows = whole_rows(batch.column(1), fitted.dims, scale, LIMIT)
            deviations = fitted.deviations(rows)
            # Components are in order of spread, so that those without any come last.
            scores = (fitted.centred(rows) @ fitted.projection.T).tolist()
            missing = [None] * (len(explained) - len(fitted.projection))
            size = len(at)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(at)),
                    "whitened": pa.array([s + missing for s in scores], pa.list_(pa.float64())),
                    "deviation": pa.array(deviations, pa.int64()),
                    "n": pa.array([fitted.count] * size, pa.int64()),
                    "explained": pa.array([explained] * size, pa.list_(pa.float64())),
                    "identity_error": pa.array([fitted.identity_error] * size, pa.float64()),
                }
            )

    return run


WHITENED = "vec_id long, whitened array<double>, deviation long, n long, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened vectors, one row for each usable one: vec_id, whitened (one number per component), deviation, n,
    explained (share of each component), identity_error.

    Repeated rows and rows without an id are whitened like any other; the components are learned from each distinct
    vector once. A component without spread has null in ``whitened``; if no vector differs, ``explained`` is null too.
    ``deviation`` is null where it doesn't fit 64 bits. Other columns are ignored; no usable vector gives no rows.
    """
    fitted = fit_whitening(vectors, components, scale)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return columns.mapInArrow(_whitener(fitted, scale), WHITENED)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    pairs = whitened.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair"))
    return pairs.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error")
