"""op13: ranked search against a brute-force scorer, with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from marketlens.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, top=50):
    found = [terms(t) for _, t in docs]
    big_n = sum(1 for f in found if f)
    big_l = sum(len(f) for f in found)
    df = Counter(t for f in found for t in set(f))
    asked = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    out = []
    for key, words in asked.items():
        scored = []
        for (doc, _), f in zip(docs, found):
            tf, m = Counter(f), 50 + (50 * len(f) * big_n) // big_l if big_l else 0
            s = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in words
                if tf[t]
            )
            if s > 0:
                scored.append((s, doc))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(key, r + 1, d, s) for r, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


DOCS = [
    (1, "Apple banana apple"),
    (2, "apple BANANA cherry"),
    (3, None),
    (4, ""),
    (5, "apple banana apple"),
    (5, "apple banana apple"),
    (None, "cherry cherry date"),
    (6, "ÄPPLE äpple x9y 12 under_score a-b"),
    (7, "word " * 20_000 + "date"),
    (8, "cherry"),
    (9, "cherry"),
]
ITEMS = [(10, "apple cherry"), (10, "date"), (11, "BANANA, x9y!"), (12, None), (None, "cherry"), (13, "äpple a b")]


def run(spark, docs, items, top=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("score"), F.lit(1).alias("rank"))
    q = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(2).alias("qkey"), F.lit(3).alias("dkey"))
    got = lexical_search.ranked_search(d, q, top=top).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_against_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_ties_and_cut(spark):
    docs = [(i, "same words here") for i in range(30, 0, -1)] + [(100, "same same")]
    items = [(1, "same here")]
    assert run(spark, docs, items, top=7) == brute(docs, items, top=7)


def test_safe_stop_keeps_every_better_document(spark, monkeypatch):
    """Common terms come last; slices of one document keep the masks exact."""
    monkeypatch.setattr(lexical_search, "SLICE_DOCS", 1)
    docs = [(i, "the " * (i % 5 + 1) + ("rare" if i % 17 == 0 else "") + " mid" * (i % 3)) for i in range(200)]
    items = [(1, "the rare mid"), (2, "the"), (3, "mid the")]
    assert run(spark, docs, items, top=5) == brute(docs, items, top=5)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS, []) == []
