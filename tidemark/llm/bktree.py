"""A BK-tree over 64-bit values under Hamming distance, as flat arrays.

Nodes are numbered level by level; the children of a node are keyed by their integer distance to it and stand in
order of (parent, distance), so that "the edges within the radius" is one range of a sorted array. A whole set of
queries walks the tree together, level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Larger than any distance of 64-bit values.
_SPAN = np.int64(128)


class BKTree:
    def __init__(self, values: np.ndarray):
        """values: distinct, uint64."""
        self.values = values
        items, parent_keys, nodes = np.arange(len(values)), [], []
        group = np.zeros(len(values), dtype=np.int64)
        made = 0
        while len(items):
            heads = np.concatenate([[True], group[1:] != group[:-1]])
            pivots = items[heads]
            nodes.append(pivots)
            number = np.cumsum(heads) - 1
            rest = ~heads
            item, at = items[rest], number[rest]
            d = np.bitwise_count(values[item] ^ values[pivots[at]]).astype(np.int64)
            key = (made + at) * _SPAN + d
            order = np.argsort(key, kind="stable")
            items, group = item[order], key[order]
            parent_keys.append(group[np.concatenate([[True], group[1:] != group[:-1]])] if len(group) else group)
            made += len(pivots)
        self.node_item = np.concatenate(nodes) if nodes else np.array([], dtype=np.int64)
        #: Of every node but the root: parent * _SPAN + distance, ascending.
        self.edge = np.concatenate(parent_keys) if parent_keys else np.array([], dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's index, value's index) at most `radius` apart, a chunk of queries at a time."""
        for start in range(0, len(queries) if len(self.values) else 0, chunk):
            yield self._walk(queries, np.arange(start, min(start + chunk, len(queries))), radius)

    def _walk(self, queries: np.ndarray, q: np.ndarray, radius: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (one of q, value's index) at most `radius` apart; nodes that have nothing `left` below are not entered."""
        node = np.zeros(len(q), dtype=np.int64)
        found = [(q[:0], q[:0])]
        while len(q):
            item = self.node_item[node]
            d = np.bitwise_count(queries[q] ^ self.values[item]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], item[hit]))
            lo = np.searchsorted(self.edge, node * _SPAN + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * _SPAN + d + radius, "right") - lo
            total = int(n.sum())
            # The k-th edge leads to node k + 1.
            node = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total) + 1
            q = np.repeat(q, n)
            if left is not None:
                enter = left[node] > 0
                node, q = node[enter], q[enter]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def spread(self, radius: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: int = 1 << 20) -> np.ndarray:
        """For each value, the smallest index of its component under links of at most `radius` that linked(a, b) allows.

        Grows one component after the other. What is in one is taken out of the tree, so that N values near each other
        cost N walks of what is left and not N * N pairs. About `pairs` pairs are looked at together.
        """
        label = np.full(len(self.values), -1)
        node_of = np.empty_like(label)
        node_of[self.node_item] = np.arange(len(label))
        left = np.zeros_like(label)
        self._count(left, np.arange(len(label)), 1)
        for seed in range(len(label)):
            if label[seed] >= 0:
                continue
            label[seed] = seed
            self._count(left, node_of[[seed]], -1)
            now = np.array([seed])
            while len(now) and left[0]:
                some = max(1, pairs // int(left[0]))
                a, b = self._walk(self.values, now[:some], radius, left)
                a, b = a[label[b] < 0], b[label[b] < 0]
                new = np.unique(b[linked(a, b)])
                label[new] = seed
                self._count(left, node_of[new], -1)
                now = np.concatenate([now[some:], new])
        return label

    def _count(self, left: np.ndarray, node: np.ndarray, by: int) -> None:
        """Adds to `left` of the nodes and of all above them."""
        while len(node):
            np.add.at(left, node, by)
            node = self.edge[node[node > 0] - 1] // _SPAN


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct values, the smallest index of its connected component under links of at most `radius`."""
    label = np.arange(len(values))
    for a, b in BKTree(values).within(values, radius):
        keep = a < b
        join(label, a[keep], b[keep])
    return label


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges, in place, the components of a[i] and b[i]; label holds each item's smallest component member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]
