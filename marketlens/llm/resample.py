"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from marketlens.llm.labelled import LABELLED_ROWS, labelled_sample
from marketlens.llm.tables import durable, end_of_task, filter_rows, lots, map_columns, task_cache

#: Buckets of word unigrams and of word bigrams, and of shape trigrams.
WORD_BUCKETS = 1 << 13
SHAPE_BUCKETS = 1 << 12
BUCKETS = 2 * WORD_BUCKETS + SHAPE_BUCKETS
#: What one n-gram's mean log-ratio counts in the key, against Gumbel noise of scale one.
SHARPNESS = 100.0
#: Words whose codes a task remembers before it starts afresh; only saves time.
REMEMBERED = 400_000
#: How much worse a rejected good document is than a kept bad one when the cut is chosen.
GOOD_COUNTS = 3.0

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Codes(dict):
    """A hash of each token whose lowest three bits are its shape."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        if not (token[0].isalnum()):
            shape = 4 if len(token) == 1 else 5
        elif token.isalpha():
            shape = 0 if token.islower() else 2 if token.isupper() and len(token) > 1 else 1 if token[1:].islower() or len(token) == 1 else 6
        else:
            shape = 3
        code = (xxh3_64_intdigest(token.lower()) & ~7) | shape
        self[token] = code
        return code


_CODES = task_cache(_Codes())
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None) -> np.ndarray:
    """Bucket numbers of all hashed n-grams of the whole text.

    Unigrams and bigrams of lower-cased tokens, and trigrams of token shapes: case, digits,
    punctuation, a run of signs, and whether a token repeats the one before it.
    """
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    codes = np.frombuffer(array("Q", map(_CODES.__getitem__, tokens)), np.uint64)
    words = codes >> np.uint64(3)
    shapes = (codes & np.uint64(7)).astype(np.int64)
    shapes[1:] += 8 * (words[1:] == words[:-1])
    pairs = (words[:-1] * _STEP + words[1:]) * _STEP >> np.uint64(40)
    padded = np.concatenate([[7, 7], shapes])
    trigrams = (padded[:-2] * 16 + padded[1:-1]) * 16 + padded[2:]
    return np.concatenate([
        (words % np.uint64(WORD_BUCKETS)).astype(np.int64),
        WORD_BUCKETS + (pairs % np.uint64(WORD_BUCKETS)).astype(np.int64),
        2 * WORD_BUCKETS + trigrams,
    ])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of the one text column; a fixed number of buckets for each task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in lots(batches):
            waiting, held = [], 0
            for body in batch.column(0).to_pylist():
                waiting.append(ngrams(body))
                held += len(waiting[-1])
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, held = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        here = np.flatnonzero(total)
        end_of_task()
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(total[here], pa.int64())], ["bucket", "n"])

    sums = texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return counts


def gumbel(key: object, seed: int) -> float:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = (xxh3_64_intdigest(str(key), seed=seed) + 0.5) / 2.0**64
    return -math.log(-math.log(u))


@dataclass
class ImportanceModel:
    """Log-ratio of target to raw probability for each bucket, and the cut on the noisy key."""

    ratio: np.ndarray
    cut: float = -math.inf
    seed: int = 0

    def weight(self, text: str | None) -> float:
        """Mean log-ratio of the text's n-grams; 0 without any."""
        found = ngrams(text)
        return float(self.ratio[found].mean()) if len(found) else 0.0

    def key(self, name: object, weight: float) -> float:
        return SHARPNESS * weight + gumbel(name, self.seed)


def fit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    rows: int = LABELLED_ROWS, seed: int = 0,
) -> ImportanceModel:
    """Models of target and raw text, and the cut that stands for k.

    Raw text is every document, whole. Target text is the good documents of fold 0 of a bounded
    labelled sample. Fold 2, which the target model has not seen, then fixes the cut on the noisy
    keys that best parts its good from its bad documents; k is the number of documents whose key
    reaches it. Without good labels the ratio is 0, without both kinds in fold 2 there is no cut,
    and nothing is rejected.
    """
    context = documents.sparkSession.sparkContext
    sample = durable(labelled_sample(documents, labels, "quality", key, text, rows))
    target = bucket_counts(sample.where("fold = 0 and label = 1").select("text"))
    if not target.sum():
        return ImportanceModel(np.zeros(BUCKETS), seed=seed)
    raw = bucket_counts(documents.select(text))
    ratio = np.empty(BUCKETS)
    for low, high in ((0, WORD_BUCKETS), (WORD_BUCKETS, 2 * WORD_BUCKETS), (2 * WORD_BUCKETS, BUCKETS)):
        t, r = target[low:high] + 1.0, raw[low:high] + 1.0
        ratio[low:high] = np.log(t / t.sum()) - np.log(r / r.sum())
    model = ImportanceModel(ratio, seed=seed)
    held = context.broadcast(model)
    scored = map_columns(
        sample.where("fold = 2").select("text", "label"),
        "weight double, label int",
        lambda texts, labels: {"weight": [held.value.weight(t) for t in texts], "label": labels},
    ).collect()  # a part of the bounded sample
    model.cut = _best_cut([(model.key(i, r.weight), r.label) for i, r in enumerate(scored)])
    return model


def _best_cut(keys: list[tuple[float, int]]) -> float:
    good = np.sort([k for k, label in keys if label])
    bad = np.sort([k for k, label in keys if not label])
    if not len(good) or not len(bad):
        return -math.inf
    at = np.unique(np.concatenate([good, bad]))
    between = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    gap = np.concatenate([[0], at[1:] - at[:-1], [0]])
    loss = GOOD_COUNTS * np.searchsorted(good, between) + len(bad) - np.searchsorted(bad, between)
    best = np.flatnonzero(loss == loss.min())
    return float(between[best[np.argmax(gap[best])]])


def score_quality(documents: DataFrame, model: ImportanceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, log_weight, sample_key, selected`` of every row.

    ``log_weight`` is the mean log importance ratio of the whole text's n-grams, ``sample_key`` adds
    Gumbel noise that depends on the key column, and the k rows whose key reaches the model's cut
    are ``selected``: the k largest, so a sample without replacement. Null and empty texts weigh 0.
    Rows equal in key and text get equal keys; a null key has noise of its own value. Other columns
    are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def scored(keys, texts):
        weights = [held.value.weight(t) for t in texts]
        return {"key": keys, "log_weight": weights, "sample_key": [held.value.key(k, w) for k, w in zip(keys, weights)]}

    rows = map_columns(documents.select(key, text), f"key {kind}, log_weight double, sample_key double", scored)
    return rows.select(
        F.col("key").alias(key), "log_weight", "sample_key", (F.col("sample_key") >= model.cut).alias("selected")
    )


def kth_largest(scored: DataFrame, k: int, column: str = "sample_key") -> float:
    """The value that exactly the k largest rows reach (more, where values tie), for a k of one's own.

    Histograms of 4,096 bins narrow the range that holds it, so nothing is sorted and each pass
    brings at most 4,096 counts to the driver.
    """
    low, high, rows = scored.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= rows:
        return -math.inf
    if k <= 0:
        return math.inf
    above = 0
    while True:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            return low
        inside = scored.where((F.col(column) >= low) & (F.col(column) <= high))
        bins = inside.groupBy(
            F.least(F.lit(4095), F.floor((F.col(column) - F.lit(low)) / F.lit(width))).alias("bin")
        ).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(bins, reverse=True):
            if above + row.n >= k:
                low, high = row.low, row.high
                break
            above += row.n
        if low == high:
            return low


def selected_documents(documents: DataFrame, model: ImportanceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``score_quality`` selects; all columns pass through."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep(keys, texts):
        return [held.value.key(k, held.value.weight(t)) >= held.value.cut for k, t in zip(keys, texts)]

    return filter_rows(documents, [key, text], keep)
