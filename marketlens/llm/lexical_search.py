"""Ranked lexical search of a stated query set by presence-mask grouping.

Statistics (document count, term total, document frequencies of the queries' terms) are Spark
aggregates. Queries are dealt to blocks; for one block at a time, every map task indexes its
documents for that block's terms and ranks them per query: the documents that hold any query term
are grouped by the mask of terms they hold, and masks are evaluated by descending upper bound
until the query's best ``top`` scores are safe. Terms are visited rarest-bound first, so documents
that hold only common terms are never scored once the best scores exceed those terms' bound.
Per-task bests are merged by salted windows; no query's postings meet in one task.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import durable, small, work_folder

# Fixed values of the ranking contract: the term pattern, the letters that are lower-cased, the
# weight and length constants, and the number of results per query.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOP = 50
LENGTH_BASE = 100 - 50
LENGTH_SCALE = 50
TF_SCALE = 1_000_000_000
TF_BASE = 1000
LENGTH_WEIGHT = 20

#: (query, term) rows of one block; a block's terms and weights are broadcast together.
BLOCK_TERMS = 200_000
#: UTF-8 bytes of text a task indexes at once.
CHUNK_BYTES = 64 << 20
#: Documents whose masks are built at once.
SLICE_DOCS = 16_384
#: Salts of the first merge of per-task bests.
MERGE_SALTS = 64

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
# on UTF-8 bytes: every byte of a character past ASCII is 0x80 or more, so terms end where they do
# in the text
_TERM = re.compile(TERM.encode())


def terms_of(text: Column) -> Column:
    """All terms of a text column, in order, with repeats; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def python_terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8 bytes, in order, with repeats."""
    return _TERM.findall((text or "").encode().translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tf_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (TF_SCALE * tf) // (TF_BASE * tf + LENGTH_WEIGHT * m)


def query_weights(documents: DataFrame, queries: DataFrame, text: str, query_key: str) -> tuple[DataFrame, int, int]:
    """``qkey, term, w`` for each distinct term of a query that some document holds; N and L.

    One scan of the documents: each document gives its distinct terms and one row under the empty
    term, which no text holds, so that a single aggregation counts document frequencies and the
    totals together. The result, one row per query term, is kept durable.
    """
    asked = queries.select(F.col(query_key).alias("qkey"), F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term")).distinct()
    vocabulary = asked.select("term").union(documents.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    rows = vocabulary.count()
    per_doc = documents.select(terms_of(F.col(text)).alias("terms")).select(
        F.size("terms").alias("n"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term")
    )
    held = durable(
        per_doc.join(small(vocabulary, rows), "term", "left_semi")
        .groupBy("term")
        .agg(F.count(F.when(F.col("n") > 0, 1)).alias("df"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    )
    totals = held.where(F.col("term") == "").first()
    n_docs, n_terms = (totals.df, totals.total) if totals else (0, 0)
    weights = asked.join(held.where(F.col("term") != ""), "term").select(
        "qkey", "term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    )
    return weights, n_docs, n_terms


def _order_key(key) -> tuple:
    return (key is None, key if key is not None else 0)


def rank_chunk(
    keys: list, texts: list, block: dict[str, list[tuple[object, int]]], n_docs: int, n_terms: int, top: int = TOP
) -> list[tuple[object, object, int]]:
    """``(query key, document key, score)`` of each query's best ``top`` documents in a chunk.

    ``block`` maps a term, in UTF-8 bytes, to its (query key, weight) pairs. Documents are grouped per query by
    the mask of its terms they hold; masks are scored by descending bound until the ``top``-th
    score exceeds every bound left. Scores of 0 are never returned.
    """
    lengths = np.zeros(len(keys), np.int64)
    postings: dict[bytes, tuple[list[int], list[int]]] = {}
    for at, body in enumerate(texts):
        found = python_terms(body)
        lengths[at] = len(found)
        for term, tf in Counter(found).items():
            if term in block:
                docs, tfs = postings.setdefault(term, ([], []))
                docs.append(at)
                tfs.append(tf)
    if not postings or n_terms == 0:
        return []
    m = LENGTH_BASE + (LENGTH_SCALE * lengths * n_docs) // n_terms
    lists = {t: (np.array(d, np.int64), tf_part(np.array(f, np.int64), m[np.array(d, np.int64)])) for t, (d, f) in postings.items()}
    asked: dict[object, list[tuple[bytes, int]]] = {}
    for term in lists:
        for query, w in block[term]:
            asked.setdefault(query, []).append((term, w))
    made = []
    for query, pairs in asked.items():
        made += [(query, keys[d], s) for d, s in _best(pairs, lists, keys, top)]
    return made


def _best(pairs, lists, keys, top) -> list[tuple[int, int]]:
    """The best ``top`` (document, score) of one query by presence masks, safe at the end."""
    bounds = [(w * int(lists[t][1].max()), t, w) for t, w in pairs]
    bounds.sort(key=lambda b: (-b[0], b[1]))
    terms = [t for _, t, _ in bounds]
    weights = np.array([w for _, _, w in bounds], np.int64)
    upper = np.array([b for b, _, _ in bounds], np.int64)
    left = np.concatenate([np.cumsum(upper[::-1])[::-1], [0]])
    seen = np.zeros(0, np.int64)
    best: list[tuple[int, int]] = []

    def threshold() -> int:
        return best[-1][1] if len(best) >= top else 1

    for j, term in enumerate(terms):
        if left[j] < threshold():
            break
        fresh = np.setdiff1d(lists[term][0], seen, assume_unique=True)
        seen = np.union1d(seen, fresh)
        for first in range(0, len(fresh), SLICE_DOCS):
            _evaluate(fresh[first : first + SLICE_DOCS], j, terms, weights, upper, lists, keys, best, threshold, top)
    return best


def _evaluate(fresh, j, terms, weights, upper, lists, keys, best, threshold, top) -> None:
    """Group ``fresh`` documents by the mask of terms ``j:`` they hold; score masks by bound."""
    if not len(fresh):
        return
    held = np.zeros((len(fresh), len(terms)), bool)
    parts = np.zeros((len(fresh), len(terms)), np.int64)
    for k in range(j, len(terms)):
        docs, part = lists[terms[k]]
        at = np.minimum(np.searchsorted(docs, fresh), len(docs) - 1)
        held[:, k] = docs[at] == fresh
        parts[held[:, k], k] = part[at[held[:, k]]]
    masks, group = np.unique(np.packbits(held, axis=1), axis=0, return_inverse=True)
    group = group.reshape(-1)
    mask_bound = np.unpackbits(masks, axis=1, count=len(terms)).astype(np.int64) @ upper
    for g in np.argsort(-mask_bound, kind="stable"):
        if mask_bound[g] < threshold():
            break
        members = fresh[group == g]
        scores = parts[group == g] @ weights
        keep = scores >= max(threshold(), 1)
        if keep.sum() > top:
            keep &= scores >= np.partition(scores, -top)[-top]
        best += [(int(d), int(s)) for d, s in zip(members[keep], scores[keep])]
        best.sort(key=lambda ds: (-ds[1], _order_key(keys[ds[0]])))
        del best[top:]


def ranked_search(
    documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", top: int = TOP
) -> DataFrame:
    """``query_key, rank, key, score``: every query's ``top`` best documents with a score above 0.

    Each row of ``documents`` is a document, repeated keys too; a null text has no terms. Rows of
    ``queries`` sharing a key (null too) are one query with all their terms. Equal scores rank by
    ascending key, null last; ranks run from 1 without gaps. Other columns are not read, whatever
    their names. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("dkey"), F.col(text).alias("text"))
    asked = queries.select(F.col(query_key).alias("qkey"), F.col(text).alias("text"))
    weights, n_docs, n_terms = query_weights(docs, asked, "text", "qkey")
    weights = durable(weights)
    count = weights.count()
    blocks = max(1, -(-count // BLOCK_TERMS))
    dealt = weights.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks)))
    kind = documents.schema[key].dataType.simpleString()
    qkind = queries.schema[query_key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    qtype = to_arrow_type(queries.schema[query_key].dataType)
    folder = f"{work_folder(spark)}/search-{uuid.uuid4().hex}"
    for block in range(blocks):
        table: dict[str, list[tuple[int, int]]] = {}
        for row in dealt.where(F.col("block") == block).toLocalIterator():
            table.setdefault(row.term.encode(), []).append((row.qkey, row.w))
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, texts, held = [], [], 0

            def flush():
                made = rank_chunk(keys, texts, shared.value, n_docs, n_terms, top)
                return pa.RecordBatch.from_arrays(
                    [pa.array([q for q, _, _ in made], qtype), pa.array([d for _, d, _ in made]), pa.array([s for _, _, s in made], pa.int64())],
                    ["qkey", "dkey", "score"],
                )

            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys.append(name)
                    texts.append(body)
                    held += len(body or "")
                    if held > CHUNK_BYTES:
                        yield flush()
                        keys, texts, held = [], [], 0
            if keys:
                yield flush()

        docs.mapInArrow(run, f"qkey {qkind}, dkey {kind}, score long").write.parquet(f"{folder}/{block}")
        shared.unpersist()
    found = spark.read.parquet(*[f"{folder}/{b}" for b in range(blocks)]) if count else spark.createDataFrame([], f"qkey {qkind}, dkey {kind}, score long")
    order = [F.desc("score"), F.asc_nulls_last("dkey")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("dkey"), F.lit(MERGE_SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("qkey", "salt").orderBy(*order))).where(f"r <= {top}")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("qkey").orderBy(*order))).where(f"rank <= {top}")
    return ranked.select(F.col("qkey").alias(query_key), F.col("rank").cast("int").alias("rank"), F.col("dkey").alias(key), "score")
