"""An R-tree over count vectors, for set overlap.

A set's tokens are hashed into groups and its point is the number of tokens in
each group.  Two sets share at most the sum of the smaller coordinate in each
group, and a set shares with any set below a node at most that sum against the
node's upper corner.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
GROUPS_LEAST, GROUPS_MOST = 16, 4096


def group_counts(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Tokens of a set in each group; groups are powers of two, so fewer groups add up neighbours."""
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def groups_for(size: int) -> int:
    """About two tokens in a group: enough groups to tell unrelated sets apart at any size."""
    return int(min(GROUPS_MOST, max(GROUPS_LEAST, 1 << max(0, int(size) // 2).bit_length())))


class CountRTree:
    """Packed bottom-up; a level holds the upper corners and the size ranges of its nodes."""

    def __init__(self, points: np.ndarray):
        self.points, sizes = points, points.sum(1)
        self.order = self._packing(points, sizes)
        upper, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(upper, low, high)]
        while len(upper) > FANOUT:
            starts = np.arange(0, len(upper), FANOUT)
            upper, low, high = np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((upper, low, high))

    @staticmethod
    def _packing(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: slices by size, in them by the counts of four coarse groups."""
        coarse = points.reshape(len(points), -1, 4).sum(1)
        slices = max(1, int(round(len(points) ** 0.5 / FANOUT)))
        by_size = np.argsort(sizes, kind="stable")
        tile = np.empty(len(points), np.int64)
        tile[by_size] = np.arange(len(points)) * slices // len(points)
        return np.lexsort((*coarse.T, tile))

    def candidates(self, point: np.ndarray, part: int, whole: int) -> np.ndarray:
        """Points that may have a Jaccard similarity of part/whole with this one, by size and by the bound."""
        size = int(point.sum())
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[k]
            fits = (whole * high[nodes] >= part * size) & (part * low[nodes] <= whole * size)
            nodes = nodes[fits]
            shared = np.minimum(upper[nodes], point).sum(1)
            # overlap / (size + other - overlap) >= part / whole for the smallest other
            nodes = nodes[(part + whole) * shared >= part * (size + low[nodes])]
            if k and len(nodes):
                below = len(self.levels[k - 1][0])
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < below]
        return self.order[nodes]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def similar(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """Whether whole * intersection >= part * union, for sorted sets."""
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b)) if len(a) < 64 else np.intersect1d(a, b, assume_unique=True).size
    return whole * shared >= part * (len(a) + len(b) - shared)


def packed_point(tokens: np.ndarray) -> bytes:
    """A set's point at its own number of groups, in one byte a group, or two where one is too few."""
    counts = group_counts(tokens, groups_for(len(tokens)))
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint16).tobytes()


def unpacked_point(raw: bytes, size: int, groups: int) -> np.ndarray:
    """A packed point at fewer groups."""
    own = groups_for(size)
    return np.frombuffer(raw, np.uint8 if len(raw) == own else np.uint16).reshape(-1, groups).sum(0, dtype=np.int64)


def size_runs(sizes: np.ndarray, part: int, whole: int) -> list[np.ndarray]:
    """Positions by size, cut where the sizes are too far apart for a link to cross."""
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(whole * sizes[order][:-1] < part * sizes[order][1:]) + 1
    return [run for run in np.split(order, ends) if len(run) > 1]


def with_candidates(sizes: np.ndarray, packed: list[bytes], part: int, whole: int) -> np.ndarray:
    """Which points have a candidate other than themselves."""
    found = np.zeros(len(sizes), bool)
    for run in size_runs(sizes, part, whole):
        groups = groups_for(int(sizes[run[0]]))
        points = np.array([unpacked_point(packed[i], int(sizes[i]), groups) for i in run], np.int32)
        tree = CountRTree(points)
        for k, point in enumerate(points):
            if not found[run[k]]:
                near = tree.candidates(point, part, whole)
                near = near[near != k]
                # the bound holds from either side
                if len(near):
                    found[run[near]] = found[run[k]] = True
    return found


def spanning_links(sets: list[np.ndarray], indexed: np.ndarray, queries: np.ndarray, part: int, whole: int) -> list[tuple[int, int]]:
    """Links between indexed sets and queries that span the same components as all their links.

    A candidate that hangs together with the query already is not verified, so a
    group of near copies costs a verification for each of its sets.
    """
    forest, links = Forest(len(sets)), []
    for run in size_runs(np.array([len(s) for s in sets]), part, whole):
        tree_of, asked = run[indexed[run]], run[queries[run]]
        if not len(tree_of) or not len(asked):
            continue
        groups = groups_for(len(sets[run[0]]))
        points = {int(i): group_counts(sets[i], groups) for i in run}
        tree = CountRTree(np.array([points[int(i)] for i in tree_of], np.int32))
        for q in asked.tolist():
            for c in tree_of[tree.candidates(points[q], part, whole)].tolist():
                if c != q and forest.root(c) != forest.root(q) and similar(sets[c], sets[q], part, whole):
                    forest.join(c, q)
                    links.append((c, q))
    return links


def linked_with(sets: list[np.ndarray], pivot: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Which sets are linked with one other; the tree's bound picks those that are verified."""
    out = np.zeros(len(sets), bool)
    groups = groups_for(min(map(len, sets)))
    tree = CountRTree(np.array([group_counts(s, groups) for s in sets], np.int32))
    for c in tree.candidates(group_counts(pivot, groups), part, whole).tolist():
        out[c] = similar(sets[c], pivot, part, whole)
    return out
