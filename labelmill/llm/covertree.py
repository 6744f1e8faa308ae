"""Cover trees over blocks of vectors.

The nodes of a level are vectors of the block, more than the level's radius apart, and every vector of the block is
within that radius of its node; the radius halves from level to level, and what is a node on one level is one on all
levels below (its own first child). The last level holds the vectors themselves. Each node also has the distance of the
farthest vector below it, by which pairs of nodes are pruned: that is never more than the level's radius promises.

A tree is a few numpy arrays, so that whole lists of node pairs can be bounded at once. Members of a node stand together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Levels between the root and the vectors.
LEVELS = 5


@dataclass
class Tree:
    """order: the block's rows in the tree's order. Per level, from the root: center (row, as a place in that order), first and end of the members, radius, and first and end of the children in the next level."""

    order: np.ndarray
    center: list[np.ndarray]
    first: list[np.ndarray]
    end: list[np.ndarray]
    radius: list[np.ndarray]
    child: list[tuple[np.ndarray, np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.center) - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Distances of the rows a[i] and b[j], pair by pair."""
    out = np.empty(len(i))
    for lo in range(0, len(i), chunk):
        x = a[i[lo : lo + chunk]] - b[j[lo : lo + chunk]]
        out[lo : lo + chunk] = np.sqrt(np.einsum("ij,ij->i", x, x))
    return out


def _net(x: np.ndarray, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A maximal set of rows more than radius apart, the first one in it, as places in rows, and which of them each row is nearest to.

    Rows are taken up in parts: those that an earlier node covers go at once, only what is left is looked at one by one.
    """
    left, nodes = np.arange(len(rows)), []
    limit = radius * radius
    while len(left):
        part, left = left[:256], left[256:]
        near = squared(x[rows[part]], x[rows[part]]) <= limit
        free = np.ones(len(part), bool)
        taken = []
        for k in range(len(part)):
            if free[k]:
                taken.append(k)
                free &= ~near[k]
        nodes.append(part[taken])
        if len(left):
            left = left[squared(x[rows[left]], x[rows[nodes[-1]]]).min(1) > limit]
    nodes = np.concatenate(nodes)
    nearest = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 1024):
        nearest[lo : lo + 1024] = squared(x[rows[lo : lo + 1024]], x[rows[nodes]]).argmin(1)
    nearest[nodes] = np.arange(len(nodes))
    return nodes, nearest


def build(x: np.ndarray, levels: int = LEVELS) -> Tree:
    """The tree of the rows of x, of which there is one at least."""
    n = len(x)
    order = np.arange(n)
    center, first, end, child = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([n])], []
    radius = [paired(x, x, order, np.zeros(n, np.int64)).max(keepdims=True)]
    reach, one = float(radius[0][0]), np.ones(1, np.int64)
    for _ in range(levels):
        if not radius[-1].any():
            break
        reach /= 2
        sizes = []
        for a, z in zip(first[-1].tolist(), end[-1].tolist(), strict=True):
            if z - a == 1:
                sizes.append(one)
                continue
            rows = order[a:z]
            nodes, nearest = _net(x, rows, reach)
            other = np.ones(len(rows), bool)
            other[nodes] = False
            # a node stands before its members, and the node above before all
            order[a:z] = rows[np.lexsort((other, nearest))]
            sizes.append(np.bincount(nearest, minlength=len(nodes)))
        kids = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
        child.append((kids[:-1], kids[1:]))
        cuts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        first.append(cuts[:-1]), end.append(cuts[1:]), center.append(cuts[:-1])
        away = paired(x, x, order, order[np.repeat(cuts[:-1], np.diff(cuts))])
        radius.append(np.maximum.reduceat(away, cuts[:-1]))
    if len(first[-1]) < n:
        child.append((first[-1], end[-1]))
        center.append(np.arange(n)), first.append(np.arange(n)), end.append(np.arange(n) + 1), radius.append(np.zeros(n))
    return Tree(order, center, first, end, radius, child)
