"""One nested record with all review statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions import text
from marketlens.operators import ranking, reviews

SIDES = ("positive", "negative")


def term_lists(enriched: DataFrame, words: int = 20, bigrams: int = 15) -> DataFrame:
    """Top words and word pairs of both polarities in one row, from one pass.

    Each task counts its own terms before the shuffle, and the rank filter is applied
    once per task before rows of one list meet, so a list never gathers a vocabulary.
    """
    rated = enriched.filter(F.col("polarity").isNotNull()).select("polarity", "tokens")

    def of_kind(kind: str, terms: Column) -> Column:
        return F.transform(
            terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"))
        )

    both = F.concat(
        of_kind("words", F.col("tokens")), of_kind("bigrams", text.ngrams(F.col("tokens"), 2))
    )
    counted = (
        ranking.one_per_element(rated, both, "t", "polarity")
        .groupBy("polarity", "t.kind", "t.term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_count = Window.partitionBy("polarity", "kind").orderBy(F.desc("n"), F.asc("term"))
    ranked = counted.withColumn("rank", F.row_number().over(by_count)).filter(
        F.col("rank") <= max(words, bigrams)
    )

    def one_list(side: str, kind: str, k: int) -> Column:
        wanted = (F.col("polarity") == side) & (F.col("kind") == kind) & (F.col("rank") <= k)
        return _ordered(F.collect_list(F.when(wanted, F.struct("rank", "term", "n")))).alias(
            f"{side}_top_{kind}"
        )

    return ranked.agg(
        *(one_list(side, "words", words) for side in SIDES),
        *(one_list(side, "bigrams", bigrams) for side in SIDES),
    )


def _ordered(ranked: Column) -> Column:
    return F.transform(
        F.array_sort(ranked), lambda r: F.struct(r["term"].alias("term"), r["n"].alias("n"))
    )


def _as_map(table: DataFrame, order: Column, key: str, value: str) -> Column:
    """A small table as one map whose entries follow ``order``."""
    entries = F.array_sort(
        F.collect_list(F.struct(order.alias("o"), F.col(key).cast("string").alias("k"),
                                F.col(value).alias("v")))
    )
    pairs = F.transform(entries, lambda e: F.struct(e["k"], e["v"]))
    return table.agg(F.map_from_entries(pairs)).scalar()


def _names(terms: Column, k: int) -> Column:
    return F.transform(F.slice(terms, 1, k), lambda t: t["term"])


def review_summary(enriched: DataFrame, status: DataFrame, drops: DataFrame) -> DataFrame:
    """All review statistics as one row.

    ``enriched`` holds the kept reviews, ``drops`` the row of ``drop_counts``. Each part
    is a scalar subquery over the columns it needs; only results of a few rows meet.
    """
    stats = reviews.review_stats(enriched)
    themes = ranking.count_elements(enriched, "themes", "theme")
    ratings = reviews.rating_distribution(enriched)
    lengths = reviews.length_by_rating(enriched)
    traces = reviews.top_status_traces(status)
    coverage = reviews.crawl_coverage(status)
    lists = term_lists(enriched)

    rating = F.col("review_rating_value")
    rows = stats.select(
        F.struct(*stats.columns).alias("review_stats"),
        _as_map(ratings, rating, "review_rating_value", "n").alias("rating_distribution"),
        ranking.first_row(lists, lists.columns).alias("_lists"),
        _as_map(themes, -F.col("n"), "theme", "n").alias("painpoint_counts"),
        _as_map(lengths, rating, "review_rating_value", "avg_length").alias(
            "rating_length_summary"
        ),
        ranking.first_row(coverage, coverage.columns).alias("_coverage"),
        _as_map(traces, -F.col("n"), "status_trace", "n").alias("_traces"),
        ranking.first_row(drops, [fv.EMPTY_REVIEW, fv.UNREADABLE_REVIEW]).alias(
            "cleaning_filters"
        ),
    )
    return rows.select(
        "review_stats",
        "rating_distribution",
        *(F.col("_lists")[name].alias(name) for name in lists.columns),
        "painpoint_counts",
        "rating_length_summary",
        F.struct(
            *(F.col("_coverage")[name].alias(name) for name in coverage.columns),
            F.col("_traces").alias("status_trace_top"),
        ).alias("crawl_status"),
        "cleaning_filters",
        F.struct(
            _names(F.col("_lists")["positive_top_words"], 5).alias("positive_words"),
            _names(F.col("_lists")["negative_top_words"], 5).alias("negative_words"),
            F.slice(F.map_keys("painpoint_counts"), 1, 4).alias("themes"),
        ).alias("headline"),
    )
