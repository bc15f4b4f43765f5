"""A prefix tree over ordered sets, searched for all sets similar enough to a probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Trie:
    """Sets of unsigned 64-bit values, each ascending; one global order serves all of them.

    The sets lie in lexicographic order, so each node of the tree is a range of sets and a depth: the sets of the
    range share their first values. Edges without branches are one node. A search counts what a node shares with the
    probe once for all sets below it, and leaves a subtree when even matching everything that remains on the shorter
    side can't reach the overlap that its smallest set needs.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.shared = np.array([self._common(x, y) for x, y in zip(self.sets, self.sets[1:], strict=False)], np.int64)
        self.tree: dict[tuple[int, int], tuple[int, int, int, list[tuple[int, int]]]] = {}

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        at = int(differ.argmax()) if n else 0
        return at if n and differ[at] else n

    def _node(self, lo: int, hi: int) -> tuple[int, int, int, list[tuple[int, int]]]:
        """Depth, smallest and largest set, and children of a range of sets."""
        if (found := self.tree.get((lo, hi))) is None:
            sizes, cuts = self.sizes[lo:hi], self.shared[lo : hi - 1]
            if hi - lo == 1:
                depth, children = len(self.sets[lo]), []
            else:
                depth = int(cuts.min())
                edges = [lo, *(lo + 1 + np.flatnonzero(cuts == depth)).tolist(), hi]
                children = list(zip(edges, edges[1:], strict=False))
            found = self.tree[lo, hi] = depth, int(sizes.min()), int(sizes.max()), children
        return found

    def search(self, probe: np.ndarray, percent: int, start: int = 0) -> Iterator[int]:
        """Indices of the given sets, from position start of the tree's order on, whose intersection with the probe is at least percent/100 of the union."""
        n = len(probe)
        stack = [(start, len(self.sets), 0, 0, 0)] if start < len(self.sets) else []
        while stack:
            lo, hi, depth, overlap, at = stack.pop()
            to, least, most, children = self._node(lo, hi)
            if 100 * min(n, most) < percent * max(n, least):
                continue
            need = -(-percent * (n + max(least, -(-percent * n // 100))) // (100 + percent))
            if overlap + min(n - at, most - depth) < need:
                continue
            if to > depth:
                edge = self.sets[lo][depth:to]
                where = at + np.searchsorted(probe[at:], edge)
                overlap += int(np.count_nonzero(probe[np.minimum(where, n - 1)] == edge)) if n else 0
                at = int(where[-1])
                at += at < n and probe[at] == edge[-1]
            if children:
                if overlap + min(n - at, most - to) >= need:
                    stack += [(a, b, to, overlap, at) for a, b in children]
            elif 100 * overlap >= percent * (n + len(self.sets[lo]) - overlap):
                yield self.order[lo]
