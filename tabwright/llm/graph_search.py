"""Approximate nearest neighbours by cosine in robust-pruned graphs.

Each shard of distinct vectors is a directed graph. Vectors enter in batches: a greedy beam search from the medoid
over the graph so far proposes neighbours, relaxed distance pruning keeps those that no kept neighbour is ``ALPHA``
times nearer to, and the reverse links are pruned the same way. Queries search every shard with a beam.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tabwright.llm.vectors import search

DEGREE = 32
BEAM = 64
ALPHA = 1.2
BATCH = 256
POOL = 128


def beam_search(points: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int):
    """The ``beam`` best points found for each query and their cosines (points -1 where there are fewer)."""
    count = len(queries)
    rows = np.arange(count)
    found = np.full((count, beam), -1, np.int32)
    score = np.full((count, beam), -np.inf, np.float32)
    opened = np.ones((count, beam), bool)
    seen = np.zeros((count, len(points) + 1), bool)
    found[:, 0], score[:, 0], opened[:, 0] = start, queries @ points[start], False
    seen[:, start] = True
    seen[:, -1] = True
    live = rows
    while len(live):
        open_score = np.where(opened[live], -np.inf, score[live])
        pick = open_score.argmax(1)
        going = open_score[np.arange(len(live)), pick] > -np.inf
        live, pick = live[going], pick[going]
        if not len(live):
            break
        opened[live, pick] = True
        near = links[found[live, pick]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        cosine = np.einsum("bkd,bd->bk", points[near], queries[live], optimize=False)
        cosine[~fresh] = -np.inf
        all_score = np.concatenate([score[live], cosine], 1)
        best = np.argpartition(-all_score, beam - 1, 1)[:, :beam]
        at = np.arange(len(live))[:, None]
        all_found = np.concatenate([found[live], near], 1)
        all_open = np.concatenate([opened[live], ~fresh], 1)
        found[live], score[live], opened[live] = all_found[at, best], all_score[at, best], all_open[at, best]
    found[score == -np.inf] = -1
    return found, score


def robust_prune(points: np.ndarray, centres: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each centre from its pool (-1: none); -1 fills the rest."""
    count, width = pool.shape
    own = points[centres]
    vectors = points[pool]
    far = 2 - 2 * np.einsum("bkd,bd->bk", vectors, own)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    ordered = np.sort(pool, 1)
    twice = np.zeros(pool.shape, bool)  # of equal entries the first in pool order stays
    if (ordered[:, 1:] == ordered[:, :-1]).any():
        order = np.argsort(pool, 1, kind="stable")
        same = np.take_along_axis(pool, order, 1)
        np.put_along_axis(twice, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
    left = (pool >= 0) & ~twice & (pool != centres[:, None])
    kept = np.full((count, degree), -1, np.int32)
    rows = np.arange(count)
    for n in range(degree):
        distance = np.where(left, far, np.inf)
        pick = distance.argmin(1)
        real = distance[rows, pick] < np.inf
        if not real.any():
            break
        kept[real, n] = pool[rows[real], pick[real]]
        left &= ~(alpha * alpha * between[rows, pick] <= far) | ~real[:, None]
        left[rows[real], pick[real]] = False
    return kept


def build(matrix: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
    """Links of each point (-1: none) and the point where searches start."""
    points = (matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]).astype(np.float32)
    points = np.concatenate([points, np.zeros((1, points.shape[1]), np.float32)])  # what -1 points to
    count = len(matrix)
    links = np.full((count + 1, degree), -1, np.int32)
    start = int((points[:count] @ points[:count].mean(0)).argmax())
    order = np.random.default_rng(count).permutation(count)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    done = 1
    while done < count:
        batch = order[done : done + min(BATCH, max(8, done // 2))]
        found, _ = beam_search(points[:-1], links[:-1], start, points[batch], beam)
        links[batch] = robust_prune(points, batch, found, degree, alpha)
        to, source = links[batch].reshape(-1), np.repeat(batch, degree)
        real = to >= 0
        to, source = to[real], source[real]
        by = np.argsort(to, kind="stable")
        to, source = to[by], source[by]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(to)]]))
        targets = to[heads]
        width = int(sizes.max())
        fresh = np.full((len(heads), width), -1, np.int32)
        fresh[np.repeat(np.arange(len(heads)), sizes), np.arange(len(to)) - np.repeat(heads, sizes)] = source
        for at in range(0, len(targets), BATCH):
            some = targets[at : at + BATCH]
            pool = np.concatenate([links[some], fresh[at : at + BATCH]], 1)
            full = (pool >= 0).sum(1) > degree
            packed = np.take_along_axis(pool, np.argsort(pool < 0, 1, kind="stable"), 1)
            links[some[~full]] = packed[~full, :degree]
            if full.any():
                links[some[full]] = robust_prune(points, some[full], packed[full, : max(POOL, degree)], degree, alpha)
        done += len(batch)
    return links[:-1], start


def _find(top: int, beam: int):
    def find(index, matrix, ids, query_ids, queries):
        links, start = index
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        points = (matrix / norms[:, None]).astype(np.float32)
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            sizes = np.sqrt(np.einsum("ij,ij->i", part, part))
            found, _ = beam_search(points, links, start, (part / sizes[:, None]).astype(np.float32), beam)
            exact = np.einsum("bkd,bd->bk", matrix[found], part) / (norms[found] * sizes[:, None])
            exact[found < 0] = -np.inf
            for own, rows, scores in zip(query_ids[at : at + BATCH], found, exact, strict=True):
                order = np.argsort(-scores, kind="stable")[: top + 8]
                hits = sorted((-float(scores[n]), other) for n in order if scores[n] > -np.inf for other in ids[rows[n]] if other != own)
                for score, other in hits[:top]:
                    yield own, other, -score

    find.score = "double"
    return find


def nearest(vectors: DataFrame, modulus: int = 50, top: int = 5, beam: int = BEAM) -> DataFrame:
    """Each query's ``top`` nearest found by cosine in double precision: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id ``modulus`` divides, candidates all rows but the query's own id; ties go to
    the smaller id. A vector that is null, empty, zero or holds null or non-finite components takes no part, nor
    does a null id; vectors of other lengths than the query's are no candidates of it. Equal rows count once; the
    ids of equal vectors are all reached through one point. Other columns are ignored.
    """
    def usable(values):
        return bool(np.any(values != 0) and 0 < values @ values < np.inf)

    return search(vectors, build, _find(top, beam), usable, modulus, top)
