"""Growing of boosted trees from histograms: the search for splits and the order of splitting.

A histogram holds, per feature and bin, the sums of gradients and Hessians and the number of rows; its last bin is for
missing values. Trees grow best first: of all leaves the one with the largest gain is split next, up to a number of leaves.
Without such a number every gain is taken, which is growth by depth. The histograms of the children of all leaves that may
be split are asked for ahead, so that the number of requests follows the depth of the tree, not its leaves, and that of
the larger child is its parent's less the smaller one's.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

MISSING = 255
HELD_BYTES = 256 << 20  # histograms of open leaves that the driver keeps for subtraction


@dataclass(frozen=True)
class Rules:
    """What a tree may look like. ``newton`` weighs rows by Hessian in the gain; else they count one each."""

    max_depth: int = 6
    max_leaves: int = 0
    reg_lambda: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    min_rows: int = 1
    newton: bool = True
    rate: float = 0.3
    leaf_scale: float = 1.0

    def value(self, sums: np.ndarray) -> float:
        """Output of a leaf: a Newton step, shortened by the learning rate."""
        gradient, hessian, rows = sums
        weight = hessian + self.reg_lambda
        return float(-self.rate * self.leaf_scale * gradient / weight) if rows and weight > 0 else 0.0

    def quality(self, sums: np.ndarray) -> np.ndarray:
        """Half of what one leaf lowers the loss by, for sums along the last axis."""
        weight = (sums[..., 1] if self.newton else sums[..., 2]) + self.reg_lambda
        return 0.5 * sums[..., 0] ** 2 / np.where(weight > 0, weight, np.inf)


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int  # values of bins up to this one go left
    missing_left: bool
    left: np.ndarray
    right: np.ndarray


def best_split(histogram: np.ndarray, rules: Rules) -> Split | None:
    """The split of one node with the largest gain: features x bins x (gradient, Hessian, rows), missing in the last bin.

    Missing values are tried on both sides. Ties go to the lower feature, the lower bin, missing values to the left;
    where a node has none, they will go with the larger side.
    """
    missing = histogram[:, -1:, :]
    below = np.cumsum(histogram[:, :-1, :], axis=1)
    whole = below[:, -1:, :] + missing
    left = np.stack([below + missing, below], axis=2)  # features x bins x side of missing x sums
    right = whole[:, :, None, :] - left
    right[..., 2] = np.rint(right[..., 2])
    allowed = np.ones(left.shape[:3], bool)
    for side in (left, right):
        allowed &= (side[..., 2] >= max(1, rules.min_rows)) & (side[..., 1] >= rules.min_weight - 1e-9)
    gain = rules.quality(left) + rules.quality(right) - rules.quality(whole)[:, :, None] - rules.min_gain
    gain = np.where(allowed, gain, -np.inf)
    # Sums of the same rows in another order differ in their last digits; such gains count as equal.
    top = float(gain.max(initial=-np.inf))
    least = 1e-10 * (1.0 + float(np.abs(rules.quality(whole)).max()))
    if not top > least:
        return None
    at = int(np.argmax(gain >= top - 1e-12 * (1.0 + abs(top))))
    feature, place, side = np.unravel_index(at, gain.shape)
    one, two = left[feature, place, side], right[feature, place, side]
    to_left = bool(side == 0) if missing[feature, 0, 2] else bool(one[2] >= two[2])
    return Split(float(gain[feature, place, side]), int(feature), int(place), to_left, one.copy(), two.copy())


@dataclass
class _Node:
    sums: np.ndarray
    depth: int
    parent: int = -1
    histogram: np.ndarray | None = None
    known: bool = False  # its split has been looked for
    split: Split | None = None
    children: tuple[int, int] | None = None


@dataclass
class Grower:
    """One tree in the making. ``features`` are the numbers of the columns its histograms have."""

    rules: Rules
    features: np.ndarray
    nodes: list[_Node] = field(default_factory=list)

    def wanted(self) -> list[int]:
        """Nodes whose histograms are needed next; none once the tree is done."""
        if not self.nodes:
            return [0]
        _, pending, ahead, room = self._walk()
        if not pending:
            return []
        asked: list[int] = []
        for parent in dict.fromkeys([self.nodes[n].parent for n in pending] + [n for _, n in heapq.nsmallest(room, ahead)]):
            children = [c for c in self.nodes[parent].children if self._open(self.nodes[c]) and not self.nodes[c].known]
            if not children:  # asked for ahead
                continue
            if self.nodes[parent].histogram is not None:
                smaller = min(self.nodes[parent].children, key=lambda c: (self.nodes[c].sums[2], c))
                asked.append(smaller)
            else:
                asked += children
        return asked

    def supply(self, histograms: dict[int, np.ndarray]) -> None:
        """Take the histograms that were asked for, and those that follow by subtraction."""
        if not self.nodes:
            first = histograms[0]
            self.nodes.append(_Node(first[0].sum(0), 0))
        for number, found in histograms.items():
            self._learn(number, found)
            parent = self.nodes[number].parent
            if parent >= 0 and self.nodes[parent].histogram is not None:
                (other,) = [c for c in self.nodes[parent].children if c != number]
                if other not in histograms and not self.nodes[other].known and self._open(self.nodes[other]):
                    rest = self.nodes[parent].histogram - found
                    rest[..., 2] = np.rint(rest[..., 2])
                    self._learn(other, rest)
        for node in self.nodes:
            if node.histogram is not None and (node.split is None or all(self.nodes[c].known or not self._open(self.nodes[c]) for c in node.children)):
                node.histogram = None
        held = [n for n in self.nodes if n.histogram is not None]
        while held and sum(n.histogram.nbytes for n in held) > HELD_BYTES:
            held.pop(0).histogram = None

    def _learn(self, number: int, histogram: np.ndarray) -> None:
        node = self.nodes[number]
        node.known, node.histogram = True, histogram
        if self._open(node):
            node.split = best_split(histogram, self.rules)
        if node.split is not None:
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [_Node(node.split.left, node.depth + 1, number), _Node(node.split.right, node.depth + 1, number)]

    def _open(self, node: _Node) -> bool:
        deep = self.rules.max_depth > 0 and node.depth >= self.rules.max_depth
        return not deep and node.sums[2] >= 2 * max(1, self.rules.min_rows) and node.sums[1] >= 2 * self.rules.min_weight - 1e-9

    def _walk(self) -> tuple[list[int], list[int], list[tuple[float, int]], int]:
        """Split best first as far as is known: nodes split, nodes to be known first, leaves that may be split, room."""
        room = self.rules.max_leaves - 1 if self.rules.max_leaves else len(self.nodes)
        chosen, heap = [], []

        def reach(number: int) -> bool:
            node = self.nodes[number]
            if not node.known:
                return not self._open(node)
            if node.split is not None:
                heapq.heappush(heap, (-node.split.gain, number))
            return True

        reach(0)
        while heap and room > 0:
            _, number = heapq.heappop(heap)
            chosen.append(number)
            room -= 1
            pending = [c for c in self.nodes[number].children if not reach(c)]
            if pending and room > 0:
                return chosen, pending, heap, room
        return chosen, [], heap, room

    def partial(self) -> dict[str, np.ndarray]:
        """All nodes so far, with the splits that may not be taken in the end."""
        return _arrays(self, {n for n, node in enumerate(self.nodes) if node.split is not None}, False)

    def tree(self) -> dict[str, np.ndarray]:
        """The finished tree: features, bins, children (-1 for leaves), values, gains, and the rows of every node."""
        return _arrays(self, set(self._walk()[0]), True)


def _arrays(grower: Grower, split: set[int], renumber: bool) -> dict[str, np.ndarray]:
    kept = [0] if renumber else list(range(len(grower.nodes) or 1))
    if renumber:
        for number in kept:  # grows while it is walked
            if number in split:
                kept += grower.nodes[number].children
    place = {n: i for i, n in enumerate(kept)}
    size = len(kept)
    out = {
        "feature": np.zeros(size, np.int32),
        "bin": np.zeros(size, np.int32),
        "missing_left": np.zeros(size, bool),
        "left": np.full(size, -1, np.int32),
        "right": np.full(size, -1, np.int32),
        "value": np.zeros(size),
        "gain": np.zeros(size),
        "rows": np.zeros(size),
    }
    for n, i in place.items():
        if n >= len(grower.nodes):
            continue
        node = grower.nodes[n]
        out["rows"][i], out["value"][i] = node.sums[2], grower.rules.value(node.sums)
        if n in split:
            out["feature"][i], out["bin"][i] = grower.features[node.split.feature], node.split.bin
            out["missing_left"][i], out["gain"][i] = node.split.missing_left, node.split.gain
            out["left"][i], out["right"][i] = (place[c] for c in node.children)
    return out


def reached(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node in which each row of binned features ends."""
    at = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins))
    while len(rows):
        rows = rows[tree["left"][at[rows]] >= 0]
        node = at[rows]
        value = bins[rows, tree["feature"][node]]
        left = np.where(value == MISSING, tree["missing_left"][node], value <= tree["bin"][node])
        at[rows] = np.where(left, tree["left"][node], tree["right"][node])
    return at


def leaf_for(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The node in which each row of plain features ends; ``cut`` holds the largest value that goes left."""
    at = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[tree["left"][at[rows]] >= 0]
        node = at[rows]
        value = x[rows, tree["feature"][node]]
        left = np.where(np.isnan(value), tree["missing_left"][node], value <= tree["cut"][node])
        at[rows] = np.where(left, tree["left"][node], tree["right"][node])
    return at


def sampled(share: float, gradients: np.ndarray, by_gradient: bool, rng: np.random.Generator, top: float = 0.2, other: float = 0.1) -> np.ndarray:
    """Weight of each row of a block in one round, 0 for rows left out.

    Uniform: each row stays with chance ``share``. By gradient: the ``top`` share with the largest gradients stay, of the
    rest the share ``other`` of all rows, which weigh more in turn.
    """
    count = len(gradients)
    if not by_gradient:
        return np.ones(count) if share >= 1 else (rng.random(count) < share).astype(float)
    keep = math.ceil(top * count)
    order = np.argsort(-gradients, kind="stable")
    weights = np.zeros(count)
    weights[order[:keep]] = 1.0
    rest = order[keep:]
    some = rng.permutation(rest)[: math.ceil(other * count)]
    if len(some):
        weights[some] = len(rest) / len(some)
    return weights
