"""Raw reviews and crawl log to cleaned reviews and a summary document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.operators import reviews, summary
from marketlens.sources import writers


# What the statistics of the summary read; the texts themselves are not among it.
STATISTIC_COLUMNS: tuple[str, ...] = (
    "ASIN", "is_verified_purchase", "review_rating_value", "review_char_length",
    "review_word_count", "polarity", "tokens", "themes", "drop_reason",
)


def staged_reviews(
    raw: DataFrame,
    threshold: float = fv.LETTER_SHARE_THRESHOLD,
    lexicon: Mapping[str, Sequence[str]] = fv.THEME_LEXICON,
    stopwords: Sequence[str] = fv.STOPWORDS,
    folder: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All reviews, repaired and enriched, as a stored table with ``drop_reason``.

    This is the one pass over the texts; everything later reads columns of its result. With
    ``columns`` only those are stored, and dropped reviews keep nothing but their reason.
    """
    tagged = reviews.tag_reviews(raw, threshold)
    enriched = reviews.enrich_reviews(tagged, lexicon, stopwords)
    measured = reviews.measure_reviews(enriched, stopwords).withColumn(
        "review_word_count", F.size("tokens").cast("bigint")
    )
    if columns is not None:
        fine = F.col("drop_reason").isNull()
        measured = measured.select(
            *(F.col(c) if c == "drop_reason" else F.when(fine, F.col(c)).alias(c) for c in columns)
        )
    return writers.staged(measured, folder)


def kept(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("drop_reason").isNull())


def summary_of(staged: DataFrame, status: DataFrame) -> DataFrame:
    """The one-row summary of staged reviews and a crawl log."""
    return summary.review_summary(kept(staged), status, reviews.drop_counts(staged))


def review_report(
    raw: DataFrame, status: DataFrame, out_dir: str, file_format: str = "parquet", **options
) -> DataFrame:
    """Write cleaned reviews and the summary below ``out_dir``; returns the summary row.

    ``reviews_cleaned`` is not written when no review is left.
    """
    staged = staged_reviews(raw, folder=f"{out_dir}/work", **options)
    cleaned = kept(staged).select(*fv.CLEAN_REVIEW_COLUMNS)
    writers.write_table(cleaned, f"{out_dir}/reviews_cleaned", file_format)
    record = writers.staged(summary_of(staged, status), f"{out_dir}/work")
    writers.write_json_document(record, f"{out_dir}/review_summary")
    return record
