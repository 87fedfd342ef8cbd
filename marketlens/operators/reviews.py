"""Review cleaning and review statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions import numbers, text
from marketlens.functions.binding import let
from marketlens.operators import ranking

_REPAIRED = (
    "review_title", "review_rating_text", "review_date", "review_text", "helpful_text",
    "is_verified_purchase",
)
_VERBATIM = ("ASIN", "review_id", "review_page")


def tag_reviews(
    raw: DataFrame,
    threshold: float = fv.LETTER_SHARE_THRESHOLD,
    garbled_markers: str = fv.GARBLED_MARKERS,
    ellipsis_first: bool = False,
) -> DataFrame:
    """Repair the text columns and add ``drop_reason``, null for reviews to keep.

    One scan feeds both the kept rows and the reason counts. Absent columns read as
    empty text.
    """
    repaired = raw.select(
        *(text.field(raw, c).alias(c) for c in _VERBATIM),
        *(
            text.repair_encoding(text.field(raw, c), ellipsis_first).alias(c)
            for c in _REPAIRED
        ),
        # The rating is read from the text as it came in.
        numbers.rating_value(text.field(raw, "review_rating_text")).alias("review_rating_value"),
    )
    unreadable = let(
        text.join_title(F.col("review_title"), F.col("review_text")),
        lambda t: text.is_garbled(t, garbled_markers) | ~text.is_mostly_english(t, threshold),
    )
    return repaired.withColumn(
        "drop_reason",
        F.when(F.col("review_text") == "", F.lit(fv.EMPTY_REVIEW)).when(
            unreadable, F.lit(fv.UNREADABLE_REVIEW)
        ),
    )


def drop_counts(tagged: DataFrame) -> DataFrame:
    """Dropped reviews per reason, in one row; both reasons always have a column."""
    reason = F.col("drop_reason")
    return tagged.agg(
        F.count_if(reason == fv.EMPTY_REVIEW).alias(fv.EMPTY_REVIEW),
        F.count_if(reason == fv.UNREADABLE_REVIEW).alias(fv.UNREADABLE_REVIEW),
        F.count_if(reason.isNull()).alias("kept"),
    )


def keep_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet ``condition``, which is read from columns as computed so far.

    A plain filter on a computed column is moved below the step that computes it and runs
    the computation twice per row. A generator that gives one row or none stays put, and
    unused columns are still pruned below it.
    """
    once = F.explode(F.when(condition, F.array(F.lit(True)))).alias("_keep")
    return table.select("*", once).drop("_keep")


def measure_reviews(tagged: DataFrame, stopwords: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """Add text length, word count and helpful count to repaired reviews."""
    body = F.col("review_text")
    words = F.size(text.tokens_of_repaired(body, stopwords))
    return tagged.withColumns(
        {
            "review_char_length": F.length(body).cast("bigint"),
            "review_word_count": words.cast("bigint"),
            "helpful_count": numbers.first_integer(F.col("helpful_text")),
        }
    )


def kept_reviews(tagged: DataFrame, stopwords: Sequence[str] = fv.STOPWORDS) -> DataFrame:
    """The 13 columns of the cleaned review table, without the dropped rows."""
    kept = keep_where(tagged, F.col("drop_reason").isNull())
    return measure_reviews(kept, stopwords).select(*fv.CLEAN_REVIEW_COLUMNS)


def clean_reviews(
    raw: DataFrame,
    threshold: float = fv.LETTER_SHARE_THRESHOLD,
    stopwords: Sequence[str] = fv.STOPWORDS,
    unique_ids: bool = False,
    garbled_markers: str = fv.GARBLED_MARKERS,
) -> DataFrame:
    """Raw reviews to cleaned reviews; ``unique_ids`` keeps one row per ``review_id``.

    Of several rows, the one whose columns come first in ascending order stays, so a second run
    gives the same rows. A missing id is an id of its own.
    """
    if unique_ids:
        row = F.struct(*raw.columns)
        raw = raw.groupBy("review_id").agg(F.min_by(row, F.struct(*(F.col(c).cast("string") for c in raw.columns))).alias("r")).select("r.*")
    return kept_reviews(tag_reviews(raw, threshold, garbled_markers), stopwords)


def polarity(rating: Column) -> Column:
    """``positive``, ``negative`` or null for ratings between the two and missing ones."""
    return F.when(rating >= fv.POSITIVE_FROM, F.lit("positive")).when(
        rating <= fv.NEGATIVE_UP_TO, F.lit("negative")
    )


def enrich_reviews(
    cleaned: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = fv.THEME_LEXICON,
    stopwords: Sequence[str] = fv.STOPWORDS,
    whole_word: bool = False,
) -> DataFrame:
    """Add ``polarity``, ``tokens`` and ``themes``; themes read the text, not the title.

    Write the result once and let the statistics read the few columns each one needs.
    """
    body = F.col("review_text")
    return cleaned.withColumns(
        {
            "polarity": polarity(F.col("review_rating_value")),
            "tokens": text.tokens_of_repaired(body, stopwords),
            "themes": text.themes_of_repaired(body, lexicon, whole_word),
        }
    )


def top_words(enriched: DataFrame, side: str, k: int = 20) -> DataFrame:
    """Most frequent words among reviews of one polarity."""
    return ranking.top_elements(enriched.filter(F.col("polarity") == side), "tokens", "word", k)


def top_ngrams(enriched: DataFrame, side: str, k: int = 15, n: int = 2) -> DataFrame:
    """Most frequent n-grams of the filtered words among reviews of one polarity."""
    grams = text.ngrams(F.col("tokens"), n)
    return ranking.top_elements(enriched.filter(F.col("polarity") == side), grams, "bigram", k)


def theme_counts(enriched: DataFrame) -> DataFrame:
    """Reviews per theme over all ratings, most frequent first."""
    counted = ranking.count_elements(enriched, "themes", "theme")
    return counted.orderBy(F.desc("n"), F.asc("theme"))


def theme_polarity(enriched: DataFrame) -> DataFrame:
    """Reviews per theme, split into positive, negative and neither."""
    side = F.col("polarity")
    return (
        ranking.one_per_element(enriched, "themes", "theme", "polarity")
        .groupBy("theme")
        .agg(
            F.count_if(side == "positive").alias("positive"),
            F.count_if(side == "negative").alias("negative"),
            F.count_if(side.isNull()).alias("neither"),
        )
    )


def review_stats(cleaned: DataFrame) -> DataFrame:
    """Totals and means of the cleaned reviews in one row."""
    one_row = cleaned.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_distinct(F.coalesce("ASIN", F.lit(""))).alias("unique_asins"),
        F.count_if(F.lower("is_verified_purchase") == "yes").alias("_verified"),
        F.sum("review_char_length").alias("_chars"),
        F.sum("review_word_count").alias("_words"),
    )
    total = F.col("total_reviews")

    def per(part: str | Column, whole: Column, digits: int) -> Column:
        part = F.col(part) if isinstance(part, str) else part
        return numbers.round_half_even(numbers.ratio(part, whole), digits)

    return one_row.select(
        "total_reviews",
        "unique_asins",
        per(total, F.col("unique_asins"), 2).alias("avg_reviews_per_asin"),
        per("_verified", total, 4).alias("verified_purchase_rate"),
        per("_chars", total, 1).alias("avg_review_char_length"),
        per("_words", total, 1).alias("avg_review_word_count"),
    )


def rating_distribution(cleaned: DataFrame) -> DataFrame:
    """Reviews per rating in numeric order; unrated reviews are left out."""
    rated = cleaned.filter(F.col("review_rating_value").isNotNull())
    return ranking.counts(rated, "review_rating_value").orderBy("review_rating_value")


def length_by_rating(cleaned: DataFrame) -> DataFrame:
    """Mean text length per rating in numeric order."""
    rated = cleaned.filter(F.col("review_rating_value").isNotNull())
    summed = rated.groupBy("review_rating_value").agg(
        F.sum("review_char_length").alias("_chars"), F.count(F.lit(1)).alias("n")
    )
    mean = numbers.round_half_even(numbers.ratio(F.col("_chars"), F.col("n")), 1)
    return summed.select("review_rating_value", mean.alias("avg_length"), "n").orderBy(
        "review_rating_value"
    )


def crawl_coverage(status: DataFrame) -> DataFrame:
    """Rows attempted, blocked rows and rate, and collected reviews, in one row.

    A count that is no finite number is skipped.
    """
    blocked = text.is_yes(text.field(status, "is_captcha"))
    collected = numbers.whole_number_or_null(text.field(status, "review_count", "0"))
    one_row = status.agg(
        F.count(F.lit(1)).alias("total_asins_attempted"),
        F.count_if(blocked).alias("captcha_rows"),
        F.coalesce(F.sum(collected), F.lit(0).cast("bigint")).alias("review_count_sum"),
    )
    rate = numbers.ratio(F.col("captcha_rows"), F.col("total_asins_attempted"))
    return one_row.withColumn("captcha_rate", numbers.round_half_even(rate, 4))


def top_status_traces(status: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent status traces; a missing trace counts as the empty text."""
    traces = status.select(text.field(status, "status_trace").alias("status_trace"))
    return ranking.top_counts(traces, "status_trace", k)
