"""A robust-pruned directed neighbour graph over the vectors of one shard."""

from __future__ import annotations

import numpy as np

#: Out-edges of a vector, width of the search beam, and how much farther a pruned edge may be.
DEGREE = 32
BEAM = 64
ALPHA = 1.2
#: Points at which walks begin, the middle and random ones, so that far clusters are reached.
ENTRIES = 64
#: Vectors that search the graph at once while it is built.
STEP = 512


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component makes all lengths equal, so the largest inner product is the nearest."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], 1)


def beam_search(
    points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int = BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points that a greedy walk meets, and their distances.

    All walks go on together: each expands the nearest point in its beam that it has not expanded,
    until none is left. Missing places hold -1 and infinity.
    """
    rows, count = len(queries), len(points)
    squares = np.einsum("ij,ij->i", points, points)
    seen = np.zeros((rows, count), bool)
    ids = np.full((rows, beam), -1, np.int64)
    far = np.full((rows, beam), np.inf)
    done = np.ones((rows, beam), bool)
    start = entries[:beam]
    ids[:, : len(start)] = start
    far[:, : len(start)] = squares[start] - 2 * queries @ points[start].T
    done[:, : len(start)] = False
    seen[:, start] = True
    walking = np.arange(rows)
    while len(walking):
        open_ = np.where(done[walking], np.inf, far[walking])
        pick = open_.argmin(1)
        going = np.isfinite(open_[np.arange(len(walking)), pick])
        walking, pick = walking[going], pick[going]
        if not len(walking):
            break
        done[walking, pick] = True
        near = edges[ids[walking, pick]]
        fresh = (near >= 0) & ~seen[walking[:, None], near]
        here = np.repeat(walking, near.shape[1])[fresh.ravel()]
        seen[here, near[fresh]] = True
        away = np.full(near.shape, np.inf)
        away[fresh] = squares[near[fresh]] - 2 * np.einsum("ij,ij->i", queries[here], points[near[fresh]])
        all_ids = np.concatenate([ids[walking], np.where(fresh, near, -1)], 1)
        all_far = np.concatenate([far[walking], away], 1)
        all_done = np.concatenate([done[walking], ~fresh], 1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        across = np.arange(len(walking))[:, None]
        ids[walking], far[walking], done[walking] = all_ids[across, keep], all_far[across, keep], all_done[across, keep]
    return ids, far


def pruned(points: np.ndarray, at: int, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse out-edges: the nearest candidate stays and drops all those that it is ``alpha`` times
    nearer to than ``at`` is, then the nearest of the rest, and so on."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != at)])
    own = points[candidates]
    away = np.einsum("ij,ij->i", own - points[at], own - points[at])
    order = np.argsort(away, kind="stable")
    candidates, own, away = candidates[order], own[order], away[order]
    squares = np.einsum("ij,ij->i", own, own)
    between = squares[:, None] + squares[None, :] - 2 * own @ own.T
    alive = np.ones(len(candidates), bool)
    chosen = []
    for i in range(len(candidates)):
        if alive[i]:
            chosen.append(i)
            if len(chosen) == degree:
                break
            alive &= alpha * alpha * between[i] > away
    return candidates[chosen]


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges (-1 where there are fewer) and the entry points of the walks.

    Starts from random edges. In random order, blocks of vectors search the graph; what they meet
    is pruned to their new edges, and each end of an edge gets the way back, pruned when full.
    """
    count = len(points)
    rng = np.random.default_rng(seed)
    edges = np.full((count, degree), -1, np.int64)
    if count < 2:
        return edges, np.arange(count)
    first = min(degree // 2, count - 1)
    edges[:, :first] = rng.integers(0, count, (count, first))
    middle = np.argmin(((points - points.mean(0)) ** 2).sum(1))
    entries = np.unique(np.concatenate([[middle], rng.choice(count, min(ENTRIES - 1, count), replace=False)]))
    order = rng.permutation(count)
    for begin in range(0, count, STEP):
        block = order[begin : begin + STEP]
        ids, _ = beam_search(points, edges, points[block], entries, beam)
        back: dict[int, list[int]] = {}
        for at, met in zip(block, ids):
            kept = pruned(points, at, np.concatenate([met, edges[at]]), degree, alpha)
            edges[at] = -1
            edges[at, : len(kept)] = kept
            for other in kept.tolist():
                back.setdefault(other, []).append(at)
        for other, more in back.items():
            used = edges[other][edges[other] >= 0]
            both = np.unique(np.concatenate([used, more]))
            if len(both) > degree:
                both = pruned(points, other, both, degree, alpha)
            edges[other] = -1
            edges[other, : len(both)] = both
    return edges, entries
