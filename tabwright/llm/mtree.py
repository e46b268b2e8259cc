"""Exact top-k search by inner product in M-trees, best first.

Each shard of distinct vectors is a tree of pages. A page has a pivot, a covering radius and its distance from the
pivot above; a row has its distance from its page's pivot. For a query q and a row x below pivot p,
``q.x = q.p + q.(x - p) <= q.p + |q| d(x, p)``, so pages and rows are passed over by stored distances alone, and a
product with a child's pivot is computed only if the bound through the parent's doesn't rule the child out. Pages are
visited best first: each query takes its first pages in descending order of their bound, which gives it a k-th score. Then
the queries of a block go on together: of all open pages the one with the largest bound is visited by all queries whose
bound for it isn't below their k-th score yet; equal scores are still visited.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.vectors import search

PAGE = 32
FAN = 16
FIRST_PAGES = 5


def build(matrix: np.ndarray) -> list[tuple]:
    """Pages as (pivot, radius, distance from parent's pivot, children or None, rows, distances of rows)."""
    rng = np.random.default_rng(len(matrix))
    pages: list[tuple | None] = []

    def far(rows, pivot):
        gap = matrix[rows] - matrix[pivot]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def add(rows, pivot, above):
        number = len(pages)
        pages.append(None)
        distance = far(rows, pivot)
        step = 0.0 if above is None else float(far(np.array([above]), pivot)[0])
        radius = float(distance.max())
        if len(rows) <= PAGE:
            pages[number] = (pivot, radius, step, None, rows, distance)
            return number
        pivots = rng.choice(rows, min(FAN, -(-len(rows) // PAGE)), replace=False)
        gaps = np.stack([far(rows, p) for p in pivots], 1)
        nearest = gaps.argmin(1)
        children = np.array([add(rows[nearest == n], p, pivot) for n, p in enumerate(pivots)])
        pages[number] = (pivot, radius, step, children, None, None)
        return number

    if len(matrix):
        gap = matrix - matrix.mean(0)
        add(np.arange(len(matrix)), int(np.einsum("ij,ij->i", gap, gap).argmin()), None)
    return pages


class _Search:
    """Best-first search of a block of queries in one tree."""

    def __init__(self, pages, matrix, ids, query_ids, queries, top: int):
        self.pages, self.matrix, self.queries, self.top = pages, matrix, queries, top
        # Whole numbers that floating point holds; else the scores are Python's integers.
        self.exact = float(np.abs(matrix).max(initial=0)) * float(np.abs(queries).max(initial=0)) * matrix.shape[1] < 2**53
        self.radius, self.step, self.pivots = (np.array([p[i] for p in pages]) for i in (1, 2, 0))
        self.entries = [None if p[4] is None else _entries(p[4], ids) for p in pages]
        self.own = np.array(query_ids, np.int64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * (1 + 1e-9) + 1e-6
        self.scores = np.full((len(queries), top), -np.inf, float if self.exact else object)
        self.best = np.full((len(queries), top), np.iinfo(np.int64).max)
        self.bounds = np.full((len(queries), len(pages)), -np.inf)  # of pages that are open to a query
        self.products = np.zeros((len(queries), len(pages)))

    def run(self) -> None:
        everyone = np.arange(len(self.queries))
        self._open(everyone, np.array([0]), np.ones((len(everyone), 1), bool))
        for _ in range(FIRST_PAGES):  # down to a leaf or a few: then most have a k-th score
            page = self.bounds.argmax(1)
            go = np.flatnonzero(self._alive(everyone, page))
            order = go[np.argsort(page[go], kind="stable")]
            self.bounds[order, page[order]] = -np.inf
            for some in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
                if len(some):
                    self._visit(int(page[some[0]]), some)
        while True:
            alive = self.bounds + (1e-9 * np.abs(self.products) + 1e-6) >= self._worst(everyone)[:, None]
            self.bounds[~alive] = -np.inf  # k-th scores only rise
            page = int(self.bounds.max(0).argmax())
            some = np.flatnonzero(self.bounds[:, page] > -np.inf)
            if not len(some):
                return
            self.bounds[some, page] = -np.inf
            self._visit(page, some)

    def _alive(self, some: np.ndarray, page: np.ndarray) -> np.ndarray:
        bound = self.bounds[some, page]
        return (bound > -np.inf) & (bound + self._slack(some, page) >= self._worst(some))

    def _worst(self, some: np.ndarray) -> np.ndarray:
        return self.scores[some, -1].astype(float)

    def _slack(self, some: np.ndarray, page) -> np.ndarray:
        return 1e-9 * np.abs(self.products[some, page]) + 1e-6

    def _open(self, some: np.ndarray, pages: np.ndarray, within: np.ndarray) -> None:
        """Products of queries with the pages' pivots, and their bounds, where ``within``."""
        products = self.queries[some] @ self.matrix[self.pivots[pages]].T
        self.products[np.ix_(some, pages)] = products
        self.bounds[np.ix_(some, pages)] = np.where(within, products + self.norms[some, None] * self.radius[pages], -np.inf)

    def _visit(self, number: int, some: np.ndarray) -> None:
        """A page, for all queries that take it in this round."""
        _, _, _, children, rows, distance = self.pages[number]
        reach = distance if children is None else self.step[children] + self.radius[children]
        most = (self.products[some, number] + self._slack(some, number))[:, None] + self.norms[some, None] * reach
        within = most >= self._worst(some)[:, None]
        some, within = some[within.any(1)], within[within.any(1)]
        kept = np.flatnonzero(within.any(0))
        if not len(some):
            return
        if children is not None:
            self._open(some, children[kept], within[:, kept])
            return
        if self.exact:
            scores = self.queries[some] @ self.matrix[rows[kept]].T
        else:
            scores = _integers(self.queries[some]) @ _integers(self.matrix[rows[kept]]).T
        place, ids = self.entries[number]
        used = np.isin(place, kept)
        scores, ids = scores[:, np.searchsorted(kept, place[used])], ids[used]
        scores = np.where(ids == self.own[some, None], -np.inf, scores)
        better = (scores >= self.scores[some, -1:]).any(1)
        some = some[better]
        scores = np.concatenate([self.scores[some], scores[better]], 1)
        ids = np.concatenate([self.best[some], np.broadcast_to(ids, (len(some), len(ids)))], 1)
        order = np.argsort(ids, 1, kind="stable")
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        order = np.argsort(-scores, 1, kind="stable")[:, : self.top]
        self.scores[some], self.best[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _entries(rows: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Place in the page and id of each copy of a page's rows."""
    place = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
    return place, np.array([i for r in rows for i in ids[r]], np.int64)


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in values], object)


def _find(top: int):
    def find(pages, matrix, ids, query_ids, queries):
        found = _Search(pages, matrix, ids, query_ids, queries, top)
        found.run()
        for own, scores, others in zip(query_ids, found.scores.tolist(), found.best.tolist(), strict=True):
            for score, other in zip(scores, others, strict=True):
                if score > -np.inf:
                    yield own, other, int(score)

    find.score = "long"
    return find


def _usable(vector: np.ndarray) -> bool:
    """No product of two such vectors leaves 64 bits."""
    return float(vector @ vector) < 2.0**62


def top_products(vectors: DataFrame, modulus: int = 50, top: int = 5, scale: float = 256.0) -> DataFrame:
    """Each query's ``top`` highest integer products: query_id, rank, vec_id, score.

    Components x count as floor(scale * x), x as double. Queries are the rows whose vec_id ``modulus`` divides,
    candidates all rows but the query's own id; ties go to the smaller id. A vector that is null, empty or holds
    null or non-finite components takes no part, nor does a null id; vectors of other lengths than the query's are
    no candidates of it. Vectors whose integers' squares sum to 2^62 or more take no part either: products of the others
    fit 64 bits. Equal rows count once. Other columns are ignored.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(x, scale))
    return search(vectors.select("vec_id", whole.alias("embedding")), build, _find(top), _usable, modulus, top)


def _floor(x, scale):
    # floor() gives a long, which non-finite and huge numbers don't have.
    scaled = x * F.lit(float(scale))
    fits = F.abs(scaled) < F.lit(float(2**52))
    return F.when(fits, F.floor(scaled).cast("double")).otherwise(scaled)
