"""Bounded labelled samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import durable

#: Labelled rows that a fit uses at most (but for the spread of a hash), whatever the table holds.
LABELLED_ROWS = 20_000


def fold(key: Column) -> Column:
    """0, 1 or 2 from crc32 of the key as text; fold 1 is held out from every fit."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
    rows: int = LABELLED_ROWS,
) -> DataFrame:
    """``text, label, fold`` of labelled documents outside the held-out fold.

    Of more than ``rows`` labels, those with the smallest key hashes are used, so the sample may be
    broadcast. Rows without key or label don't count; of repeated labels the largest holds.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(F.col(key)) != 1))
    single = durable(usable.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label")))
    share = min(1.0, rows / max(1, single.count()))
    chosen = single.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    bodies = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return bodies.join(F.broadcast(chosen), "key").select("text", "label", fold(F.col("key")).alias("fold"))
