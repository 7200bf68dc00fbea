"""A prefix tree over ordered sets, walked with overlaps shared by all sets below a node.

The sets are sorted, so a node is a range of them together with the length of their common beginning;
children are the ranges that agree on one item more. Nothing but the sorted sets and a few bounds of each
node is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Groups:
    """Disjoint groups of set numbers."""

    def __init__(self, count: int):
        self.parent = list(range(count))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


class Node:
    __slots__ = ("depth", "end", "start", "shared", "children", "small", "large", "longest", "same")

    def __init__(self, start: int, end: int, depth: int):
        self.start, self.end, self.depth = start, end, depth
        self.children: list[Node] | None = None
        self.same = -1  # a member, once all members are known to be in one group


class PrefixTree:
    """`sets`: arrays of distinct items, whose global order is that of numbers; `sizes`: what each counts for in the union.

    Two sets are alike if the intersection is at least `share` (a fraction of whole numbers) of the union.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], share: tuple[int, int]):
        self.share = share
        self.universe = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.int64)
        # Numbers rise as items fall, so every set begins with its last item in the global order.
        dense = [np.sort(len(self.universe) - 1 - np.searchsorted(self.universe, s)) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: dense[i].astype(">u4").tobytes())
        self.order = order
        self.sets = [dense[i] for i in order]
        self.sizes = np.array([sizes[i] for i in order], np.int64)
        self.lengths = np.array([len(s) for s in self.sets], np.int64)
        self.mask = np.zeros(len(self.universe), bool)
        self.root = self._node(0, len(self.sets), 0) if self.sets else None

    def _node(self, start: int, end: int, depth: int) -> Node:
        node = Node(start, end, depth)
        first, last = self.sets[start], self.sets[end - 1]
        room = min(len(first), len(last))
        differs = np.flatnonzero(first[depth:room] != last[depth:room])
        reach = depth + int(differs[0]) if len(differs) else room
        node.shared = first[depth:reach]
        node.depth = reach
        node.small, node.large = int(self.sizes[start:end].min()), int(self.sizes[start:end].max())
        node.longest = int(self.lengths[start:end].max()) - reach
        if end - start == 1:
            node.same = start
        return node

    def _children(self, node: Node) -> list[Node]:
        if node.children is None:
            node.children, at = [], node.start
            # Equal sets and sets that end here come first and are leaves of their own.
            while at < node.end and self.lengths[at] == node.depth:
                leaf = Node(at, at + 1, node.depth)
                leaf.shared, leaf.longest, leaf.same = self.sets[at][:0], 0, at
                leaf.small = leaf.large = int(self.sizes[at])
                node.children.append(leaf)
                at += 1
            while at < node.end:
                item, upto = self.sets[at][node.depth], at + 1
                while upto < node.end and self.sets[upto][node.depth] == item:
                    upto += 1
                node.children.append(self._node(at, upto, node.depth))
                at = upto
        return node.children

    def _least(self, size: int, other: int) -> int:
        """The smallest intersection that makes sets of these sizes alike."""
        over, under = self.share
        return -(-over * (size + other) // (over + under))

    def alike(self, probe: np.ndarray, size: int, groups: Groups | None = None, own: int = -1) -> Iterator[int]:
        """Numbers (places in sorted order) of stored sets that are alike to the probe.

        `probe` has dense item numbers, rising. With `groups`, sets already in the group of `own` are
        passed over; the caller unites what is reported before it asks for the next.
        """
        if self.root is None:
            return
        over, under = self.share
        smallest, largest = -(-over * size // under), under * size // over
        self.mask[probe] = True
        try:
            yield from self._walk(self.root, 0, probe, size, smallest, largest, groups, own)
        finally:
            self.mask[probe] = False

    def _walk(self, root, overlap, probe, size, smallest, largest, groups, own) -> Iterator[int]:
        """Depth first with a stack of its own, as a path may have as many nodes as a set has items."""
        stack: list[tuple[Node, int] | Node] = [(root, overlap)]
        while stack:
            top = stack.pop()
            if isinstance(top, Node):  # its children are done
                self._note_same(top, groups)
                continue
            node, overlap = top
            if node.large < smallest or node.small > largest:
                continue
            if groups is not None and node.same >= 0 and groups.find(node.same) == groups.find(own):
                continue
            if len(node.shared):
                overlap += int(np.count_nonzero(self.mask[node.shared]))
            least = self._least(size, max(node.small, smallest))
            if overlap + node.longest < least:
                continue
            if len(node.shared) and overlap < least:
                after = len(probe) - int(np.searchsorted(probe, node.shared[-1], "right"))
                if overlap + min(after, node.longest) < least:
                    continue
            if node.end - node.start == 1:
                if overlap >= self._least(size, int(self.sizes[node.start])):
                    yield node.start
                continue
            if groups is not None:
                stack.append(node)
            stack.extend((child, overlap) for child in reversed(self._children(node)))

    @staticmethod
    def _note_same(node: Node, groups: Groups) -> None:
        if node.same < 0 and all(c.same >= 0 for c in node.children):
            if len({groups.find(c.same) for c in node.children}) == 1:
                node.same = node.children[0].same

    def numbered(self, items: np.ndarray) -> np.ndarray:
        """Dense numbers, rising, of a probe's items; items that no stored set has are left out."""
        place = np.searchsorted(self.universe, items)
        place[place == len(self.universe)] = 0
        known = place[self.universe[place] == items] if len(self.universe) else place[:0]
        return np.sort(len(self.universe) - 1 - known)

    def spanning_links(self) -> Iterator[tuple[int, int]]:
        """Links of the stored sets among each other (numbers as given), enough to connect what links connect."""
        groups = Groups(len(self.sets))
        for number in range(len(self.sets)):
            for other in self.alike(self.sets[number], int(self.sizes[number]), groups, number):
                if groups.find(other) != groups.find(number):
                    groups.unite(other, number)
                    yield self.order[number], self.order[other]
