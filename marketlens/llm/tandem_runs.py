"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

For each document, words become integer ids; its suffix array, inverse and LCP array make an
enhanced suffix array. A bottom-up pass over the LCP intervals finds every branching square: for
an interval of depth ``d``, each suffix ``i`` outside the largest child tests whether ``i + d`` or
``i - d`` lies in the same interval (by the inverse array) and whether the square cannot be shifted
right. Squares are then rotated left and merged into maximal runs, smallest period first, so a
square whose root is not primitive joins the run of its primitive period. No tree nodes are built.
Documents run in parallel map tasks, batched by bytes; a document with no repeated six-word
sequence cannot hold a run of twelve words and skips the suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: a run holds at least this many words and two periods.
LEAST_LENGTH = 12
#: Text handled at once by a task, in UTF-8 bytes.
BATCH_BYTES = 16 << 20
#: Words of the sequence whose repeat any run must contain: LEAST_LENGTH - LEAST_LENGTH // 2.
SCREEN = LEAST_LENGTH // 2


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words after the contract's rewriting for a document whose crc32 is ``h``."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        if k < n:
            second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        step = np.ones(n, np.int64)
        step[0] = 1
        step[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(step)
        rank = fresh
        if rank.max() == n or k >= n:
            return order
        k *= 2


def lcp_array(s: list[int], sa: list[int], isa: list[int]) -> list[int]:
    """``lcp[r]``: common prefix of the suffixes ranked ``r - 1`` and ``r`` (Kasai); ``lcp[n]`` is 0."""
    n, h = len(s), 0
    lcp = [0] * (n + 1)
    for i in range(n):
        r = isa[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp


def branching_squares(s: list[int]) -> set[tuple[int, int]]:
    """``(start, period)`` of every branching square: one that cannot be shifted right."""
    n = len(s)
    sa = suffix_array(np.array(s, np.int64)).tolist()
    isa = [0] * n
    for r, i in enumerate(sa):
        isa[i] = r
    lcp = lcp_array(s, sa, isa)
    found: set[tuple[int, int]] = set()

    def visit(lb: int, rb: int, d: int, children: list[tuple[int, int]]) -> None:
        skip_lo, skip_hi = max(children, key=lambda c: c[1] - c[0]) if children else (lb, lb - 1)
        for r in (*range(lb, skip_lo), *range(skip_hi + 1, rb + 1)):
            i = sa[r]
            j = i + d
            if j < n and lb <= isa[j] <= rb and (i + 2 * d >= n or s[i] != s[i + 2 * d]):
                found.add((i, d))
            j = i - d
            if j >= 0 and lb <= isa[j] <= rb and (j + 2 * d >= n or s[j] != s[j + 2 * d]):
                found.add((j, d))

    stack: list[list] = [[0, 0, []]]  # depth, left bound, child intervals
    for r in range(1, n + 1):
        lb, last = r - 1, None
        while lcp[r] < stack[-1][0]:
            depth, lb, children = stack.pop()
            if depth > 0:
                visit(lb, r - 1, depth, children)
            last = (lb, r - 1)
            if lcp[r] <= stack[-1][0]:
                stack[-1][2].append(last)
                last = None
        if lcp[r] > stack[-1][0]:
            stack.append([lcp[r], lb, [last] if last else []])
    return found


def runs_of(s: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``s``, by start, then period."""
    n = len(s)
    if n < LEAST_LENGTH or not _repeats(s):
        return []
    by_end: dict[int, list[tuple[int, int]]] = {}
    runs = []
    for i, d in sorted(branching_squares(s), key=lambda x: (x[1], x[0])):
        end = i + 2 * d
        if any(d % q == 0 and start <= i for q, start in by_end.get(end, ())):
            continue  # the root repeats a shorter period, whose run this is
        start = i
        while start > 0 and s[start - 1] == s[start - 1 + d]:
            start -= 1
        by_end.setdefault(end, []).append((d, start))
        if end - start >= max(LEAST_LENGTH, 2 * d):
            runs.append((start, end - start, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _repeats(s: list[int]) -> bool:
    """Whether some ``SCREEN`` consecutive words occur twice; every run needs that."""
    ids = np.array(s, np.uint64)
    if len(ids) < SCREEN + 1:
        return False
    h = np.zeros(len(ids) - SCREEN + 1, np.uint64)
    for k in range(SCREEN):
        h = h * np.uint64(1_000_003) + ids[k : len(ids) - SCREEN + 1 + k]
    return len(np.unique(h)) < len(h)


def describe(words: list[bytes]) -> dict:
    """The digest columns of one sequence of UTF-8 words."""
    ids: dict[bytes, int] = {}
    s = [ids.setdefault(w, len(ids) + 1) for w in words]
    runs = runs_of(s)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped)[: len(words)] > 0
    kept = b" ".join(w for w, out in zip(words, gone.tolist()) if not out)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return {
        "n_runs": len(runs),
        "start": longest and longest[0],
        "length": longest and longest[1],
        "period": longest and longest[2],
        "exponent_milli": longest and 1000 * longest[1] // longest[2],
        "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
    }


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    Words are the maximal stretches of non-white-space (space, tab to carriage return); a null text
    has none. A document whose crc32 of its decimal key ends in 0 is rewritten as the contract says
    (a null key: never). ``start``..``exponent_milli`` describe the longest run (ties: smaller
    start, then period) and are null without runs; the digests are never null (of the empty text
    without words). Every row gives one row, repeated ones too; other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()
            return made

        for batch in batches:
            for name, h, body in zip(*(c.to_pylist() for c in batch.columns)):
                words = planted((body or "").encode().split(), h)
                rows.append({"key": name, **describe(words)})
                held += len(body or "")
                if held > BATCH_BYTES:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    framed = documents.select(
        F.col(key).alias("key"), F.crc32(F.col(key).cast("string")).alias("h"), F.col(text).alias("text")
    )
    return framed.mapInArrow(run, schema).select(F.col("key").alias(key), *FIELDS)
