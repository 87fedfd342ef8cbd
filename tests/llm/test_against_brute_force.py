"""Operators against plain versions of themselves on the small tables and on random input."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from marketlens.llm import decontaminate, jaccard, nearest, packing, resample, url_rules, vector_graph
from marketlens.llm.prefix_tree import PrefixTree
from marketlens.llm.queries import vocabulary
from marketlens.llm.tables import table
from tests.oracle_compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", ["op1_sharding", "op3_url_filter", "op5_decontamination", "op6_license_scan"])
def test_against_sql(spark, name):
    assert differences(driver.queries()[name](spark, SF_DIR), connect(SF_DIR), driver.oracle_sql()[name]) is None


def brute_classes(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, text in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        runs = [tuple(words[j : j + 5]) for j in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[i] = frozenset(runs)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for place, a in enumerate(ids):
        for b in ids[:place]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_on_the_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    found = jaccard.similar_documents(table(spark, SF_DIR, "documents")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(texts)


def test_jaccard_on_near_copies_and_chains(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for family in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((12, 60, 200)))]
        for _ in range(25):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(500)}"
            rows.append((len(rows) * 7 % 151, " ".join(words)))
    rows.append((1000, " ".join(["hot"] * 40)))
    monkeypatch.setattr(jaccard, "TREE_SHINGLES", 300)  # many blocks
    monkeypatch.setattr(jaccard, "GROUP_SETS", 5)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_classes(dict(rows))


def test_prefix_tree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64)[::-1] for _ in range(300)]
    tree = PrefixTree(sets)
    for query in sets[:60]:
        want = []
        for i, s in enumerate(sets):
            both = len(np.intersect1d(query, s))
            if 100 * both >= 60 * (len(query) + len(s) - both):
                want.append(i)
        assert sorted(tree.similar(query, 60)) == want
        assert sorted(tree.similar(query, 60, np.arange(0, 300, 3))) == [i for i in want if i % 3 == 0]


@pytest.mark.parametrize("at_once", [10, 1000])
def test_components(spark, monkeypatch, at_once):
    from marketlens.llm import components

    rng = random.Random(at_once)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(50)]
    rng.shuffle(pairs)
    parent = {n: n for p in pairs for n in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    loops = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    assert {r.node: r.component for r in found} == {n: c for n, c in parent.items() if n not in loops}


def test_search_for_words():
    rng = random.Random(3)
    for _ in range(150):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for i in range(6)]
        words = [rng.choice("abc").encode() for _ in range(rng.randrange(0, 60))]
        spans, found = decontaminate.WordSearch(items, window=4).find(words)
        hit, names = set(), set()
        for name, text in items:
            own = text.encode().split()
            size = min(4, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        names.add(name)
        assert {w for a, b in spans for w in range(a, b)} == hit and found == names


def test_benchmark_in_several_blocks(spark):
    docs, bench = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    one = decontaminate.contamination(decontaminate.benchmark_hits(docs, bench))
    many = decontaminate.contamination(decontaminate.benchmark_hits(docs, bench, pattern_bytes=2000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_rules_in_several_blocks(spark):
    rng = random.Random(2)
    hosts = [".".join(rng.choice(("a", "b", "com", "net")) for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    paths = ["/" + "/".join(rng.choice("xy") for _ in range(rng.randrange(0, 4))) for _ in range(80)]
    pages = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    rules = sorted({(rng.choice(hosts), rng.choice(paths[:9])): rng.choice(("allow", "block")) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    found = url_rules.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string").repartition(3),
        spark.createDataFrame(rules, "host string, path string, verdict string"), rule_bytes=2000,
    ).collect()
    for row in found:
        fits = [
            (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (row.host == h or row.host.endswith("." + h)) and row.path.startswith(p)
        ]
        assert (row.rule, row.verdict) == (max(fits)[3:] if fits else (None, "allow"))


def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    by = defaultdict(list)
    for row in packing.packed(table(spark, SF_DIR, "documents"), vocabulary()).collect():
        by[row.doc_id].append(row)
    for doc in table(spark, SF_DIR, "documents").collect():
        ids = np.array([*plain.encode(doc.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for row in sorted(by[doc.doc_id], key=lambda r: r.start):
            assert (row.start, row.doc_tokens, row.offset) == (at, len(ids), 0)
            assert row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids)


@pytest.mark.parametrize("text", ["it's <|endoftext|>x don't", "a\u00a0b \u2028 c", "e\u0301 \x1f x\x1fy \x1c z", "ΑΣ ΟΔΟΣ ÀÉ"])
def test_odd_words(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids
    got = np.frombuffer(packing.WordTokenizer(vocabulary()).encode(["some words", text])[1], "<u4").tolist()
    assert got == want


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice((rng.random(), 0.5, 1e9 * rng.random())) for _ in range(500)]
    scored = spark.createDataFrame([(v,) for v in values], "sample_key double")
    for k in (1, 2, 77, 250, 499):
        assert resample.kth_largest(scored, k) == sorted(values, reverse=True)[k - 1]


def test_recall_of_the_graphs(spark):
    vectors = table(spark, SF_DIR, "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    found = defaultdict(list)
    for r in nearest.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=200).collect():
        found[r.query_id].append(r)
        assert abs(r.score - rows[r.query_id] @ rows[r.vec_id]) < 1e-12
    hits = total = 0
    for q, got in found.items():
        best = sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20]
        hits += len(set(best) & {r.vec_id for r in got})
        total += 20
        assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 21))
    assert hits / total >= 0.95


def test_recall_with_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    own = rng.normal(size=(900, 16)).astype("float32")
    own[rng.choice(900, 320, replace=False)] = own[0]
    own[rng.choice(900, 60, replace=False)] = own[1]
    order = rng.permutation(900)
    rows = {int(i): own[n].astype(float) for n, i in enumerate(order)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>").repartition(7)
    asked = [int(order[n]) for n in (0, 1, 5, 6, 7, 8)] + [i for i, v in rows.items() if (v == own[0]).all()][:30]
    got = defaultdict(list)
    for r in nearest.nearest_vectors(vectors, vectors.where(F.col("vec_id").isin(asked)), shard_rows=300).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    ids = np.array(sorted(rows))
    points = np.stack([rows[i] for i in ids.tolist()])
    hits = 0
    for q in set(asked):
        scores = (points * rows[q]).sum(1)
        best = [int(ids[n]) for n in np.lexsort((ids, -scores)) if ids[n] != q][:20]
        assert len(got[q]) == 20
        hits += len(set(best) & set(got[q]))
        if (rows[q] == own[0]).all():
            top = [i for i in best if (rows[i] == own[0]).all()]
            assert not top or set(top) <= set(got[q])
    assert hits >= 0.97 * 20 * len(set(asked))


def test_pruning_keeps_diverse_edges():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1], [5, 5]])
    assert vector_graph.pruned(points, 0, np.arange(5)).tolist() == [1, 3, 4]


def test_held_out_accuracy(spark):
    sf = os.path.dirname(SF_DIR) + "/sf0.01"
    labels = table(spark, sf, "labels")
    toxic = driver.queries()["op10_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in toxic) >= 0.9 * len(toxic)
    good = driver.queries()["op7_quality"](spark, sf).join(labels, "doc_id").collect()
    assert sum(r.selected == (r.quality == 1) for r in good) >= 0.97 * len(good)
