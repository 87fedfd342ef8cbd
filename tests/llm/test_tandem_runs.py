"""op12: runs against a brute-force scan of every period, and the query's digests on whole texts."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm import tandem_runs


def brute_runs(s):
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            if s[x] == s[x + q]:
                a = x
                while x + q < n and s[x] == s[x + q]:
                    x += 1
                if x + q - a >= max(12, 2 * q):
                    found[(a, x + q)] = min(found.get((a, x + q), q), q)
            else:
                x += 1
    return sorted(((a, e - a, q) for (a, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        doc_id,
        len(runs),
        *(best if best else (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("alphabet", [1, 2, 3, 6])
def test_runs_against_every_period(alphabet):
    rng = random.Random(alphabet)
    for _ in range(400):
        s = [rng.randint(1, alphabet) for _ in range(rng.randint(0, 120))]
        if s and rng.random() < 0.4:
            p, a = rng.randint(1, 9), rng.randrange(len(s))
            s = s[:a] + [s[a + (i - a) % p] for i in range(a, len(s))]
        assert tandem_runs.runs_of(s) == brute_runs(s)


EDGES = [
    (-10, None),
    (-11, ""),
    (-12, " \t\n "),
    (-13, "a " * 40),
    (-13, "a " * 40),
    (None, "x y " * 30),
    (-14, "one two one two " * 20 + "tail"),
    (-15, "w%d " * 0 + " ".join(f"w{i % 7}" for i in range(5000))),
    (-16, "long " * 100_000),
]


def test_edges_and_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) <= 1500]
    rows = EDGES + short[:60]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.lit("x").alias("key"), F.lit(1).alias("h"), F.lit(2).alias("n_runs")
    )
    got = sorted((tuple(r) for r in tandem_runs.periodic_runs(frame).collect()), key=str)
    want = sorted((brute_row(k, t) for k, t in rows if k != -16), key=str)
    got_long = [r for r in got if r[0] == -16]
    assert [r for r in got if r[0] != -16] == want
    assert got_long[0][1:5] == (1, 0, 100_000, 1)
    assert any(r[1] > 0 for r in want if r[0] is not None and r[0] >= 0)  # planted rewriting occurs


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert tandem_runs.periodic_runs(frame).count() == 0
