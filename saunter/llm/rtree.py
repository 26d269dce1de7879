"""An R-tree over points of non-negative counts, and a join of such a tree with itself.

A point counts how many of a set's elements hash into each group. Two sets share at most
the sum over the groups of the smaller count; for two tree nodes, of the smaller of the
coordinate maxima. `similar_pairs` goes down both sides of the tree at once, as long as
that bound and the node's size ranges leave a similar pair possible.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
LEAST_GROUPS = 64
CHUNK = 2048


def group_counts(hashes: np.ndarray) -> np.ndarray:
    """A set's point: two to four elements a group, in LEAST_GROUPS to 4096 groups (a power of two)."""
    groups = max(LEAST_GROUPS, 1 << min(12, (len(hashes) // 4).bit_length()))
    counts = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """The points in the number of groups that all have: groups are low bits of hashes, so they add up."""
    groups = min(map(len, points))
    return np.stack([p.astype(np.int32).reshape(-1, groups).sum(axis=0) for p in points])


class RTree:
    """Packed bottom-up: entries sorted by class, size and first coordinates; FANOUT children a node.

    An entry is a point with its size and class, or a box: the largest coordinates of several points,
    with their ranges of sizes and of classes.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, classes: np.ndarray, most: np.ndarray | None = None, last: np.ndarray | None = None):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes, classes))
        most, last = sizes if most is None else most, classes if last is None else last
        p = points[self.order]
        self.levels = [(p, *(x[self.order] for x in (sizes, most, classes, last)))]
        while len(p) > 1:
            at = np.arange(0, len(p), FANOUT)
            p = np.maximum.reduceat(p, at)
            _, least, most, first, last = self.levels[-1]
            self.levels.append((p, np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        p, least, most, first, last = self.levels[level]
        one_class = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b])
        fits = ~one_class & (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        keep = np.flatnonzero(fits)
        shared = np.minimum(p[a[keep]], p[b[keep]]).sum(axis=1)
        # 100 i >= percent * (|A| + |B| - i)
        return keep[(100 + percent) * shared.astype(np.int64) >= percent * (least[a[keep]] + least[b[keep]]).astype(np.int64)]

    def similar_pairs(self, percent: int):
        """Arrays (i, j) of entries of different classes whose bound allows ``percent`` similarity."""
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK:
                stack += [(level, a[i : i + CHUNK], b[i : i + CHUNK]) for i in range(0, len(a), CHUNK)]
                continue
            keep = self._possible(level, a, b, percent)
            a, b = a[keep], b[keep]
            if level == 0:
                apart = a != b
                if apart.any():
                    yield self.order[a[apart]], self.order[b[apart]]
                continue
            below = len(self.levels[level - 1][1])
            x = np.repeat(a * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(np.arange(FANOUT), FANOUT), len(a))
            y = np.repeat(b * FANOUT, FANOUT * FANOUT) + np.tile(np.arange(FANOUT), FANOUT * len(a))
            fine = (x < below) & (y < below) & (x <= y)
            if fine.any():
                stack.append((level - 1, x[fine], y[fine]))


def candidate_pairs(points: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, percent: int):
    """`RTree.similar_pairs` over points of several lengths, each pair in the finest groups that both have.

    Similar sets differ in size by less than a factor of two (percent > 50), so the lengths of
    their points are equal or neighbours: there is a tree for each length and the next.
    """
    if 2 * percent <= 100:
        raise ValueError("percent must be above 50")
    lengths = np.array([len(p) for p in points])
    for groups in np.unique(lengths):
        own = lengths == groups
        largest = 100 * sizes[own].max()
        at = np.flatnonzero(own | (lengths == 2 * groups) & (percent * sizes <= largest))
        if len(at) < 2:
            continue
        tree = RTree(folded([points[k] for k in at]), sizes[at], classes[at])
        for a, b in tree.similar_pairs(percent):
            a, b = at[a], at[b]
            here = own[a] | own[b]
            yield a[here], b[here]
