"""A prefix tree over ordered sets, queried for all sets similar to one."""

from __future__ import annotations

import numpy as np


def least_overlap(a, b, percent: int):
    """Smallest intersection with 100 * intersection >= percent * union for set sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    """So many first members of a set of ``n`` hold one of any set that is similar to it."""
    return n + 1 + -n * percent // 100


class PrefixTree:
    """Sets in one falling order of their numbers, so the commonest come first and near copies
    share long paths.

    The tree is kept as the sorted list of the sets: a node is a range of it, its edge the numbers
    that the first and the last set of the range share.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        self.place = np.empty(len(sets), np.int64)
        self.place[self.order] = np.arange(len(sets))
        self.sets = [sets[i] for i in self.order]
        self.lengths = np.array([len(s) for s in self.sets], np.int64)

    def similar(self, query: np.ndarray, percent: int, among: np.ndarray | None = None) -> list[int]:
        """Positions of the sets (of ``among``, if given) whose Jaccard similarity is at least ``percent``.

        An edge's overlap with the query is counted once for all sets below it. A node is left as
        soon as the overlap so far plus what can still follow, the shorter rest of the two, is too
        little for the smallest set below it.
        """
        rows = np.arange(len(self.sets)) if among is None else np.sort(self.place[among])
        lengths = self.lengths[rows]
        sets = [self.sets[i] for i in rows]
        rising = query[::-1]
        size = len(query)

        def shared(numbers: np.ndarray) -> int:
            if not size:
                return 0
            at = np.searchsorted(rising, numbers)
            at[at == size] = 0
            return int(np.count_nonzero(rising[at] == numbers))

        found = []
        todo = [(0, len(sets), 0, 0)] if sets else []
        while todo:
            low, high, depth, overlap = todo.pop()
            first, last = sets[low], sets[high - 1]
            if high - low == 1:
                end = len(first)
            else:
                end = min(len(first), len(last))
                differs = np.flatnonzero(first[depth:end] != last[depth:end])
                end = depth + int(differs[0]) if len(differs) else end
            overlap += shared(first[depth:end])
            # what the query still has behind this edge: its numbers below the edge's last one
            rest = int(np.searchsorted(rising, first[end - 1])) if end else size
            below = lengths[low:high]
            if overlap + min(int(below.max()) - end, rest) < least_overlap(size, int(below.min()), percent):
                continue
            while low < high and lengths[low] == end:  # sets that end at this node
                if overlap >= least_overlap(size, end, percent):
                    found.append(int(self.order[rows[low]]))
                low += 1
            while low < high:  # children: runs of sets with the same next number
                mark = sets[low][end]
                a, b = low, high
                while b - a > 1:  # the end of the run; the list is sorted
                    middle = (a + b) // 2
                    a, b = (middle, b) if sets[middle][end] == mark else (a, middle)
                todo.append((low, b, end, overlap))
                low = b
        return found
