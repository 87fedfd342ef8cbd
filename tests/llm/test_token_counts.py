"""op11: counts equal the tokenizer's own, on edge cases and on whole sf0.001 texts."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marketlens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a<|endoftext|>b <|endoftext|><|endoftext|>  x  \n\n y"),
    (5, "it's  'S 123 x 😀 Ünï çödé 漢字"),
    (5, "it's  'S 123 x 😀 Ünï çödé 漢字"),
    (None, "no key"),
    (6, "word " * 50_000),
]


def test_edges_and_clashing_columns(spark):
    frame = spark.createDataFrame(EDGES, "doc_id long, text string").select(
        "*", F.lit("x").alias("n_tokens"), F.lit("y").alias("key"), F.lit(1).alias("n_bytes")
    )
    rows = token_counts.token_counts(frame, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((k or -1, brute(t)) for k, t in EDGES)
    for row in rows:
        text = dict((k, t) for k, t in EDGES if k == row.doc_id).get(row.doc_id)
        assert row.n_bytes == len((text or "").encode())
        assert row.over_limit == (row.n_tokens > 512)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(frame, PATH).count() == 0


@pytest.mark.parametrize("entries", [0, 50])
def test_whole_documents_against_tokenizer(spark, monkeypatch, entries):
    """Counts are the same whether pre-tokens come from the table or the task's cache."""
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.select("doc_id", "text").collect()}
    assert got == want
