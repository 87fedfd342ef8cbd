"""Keyword coverage of listings and counts over a keyword table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators import ranking

# The category word that all keywords share; it says nothing about a bullet.
GENERIC_WORDS: tuple[str, ...] = ("case",)
STEM_LENGTH = 6
KEYWORDS_PER_PASS = 200


def _words(keyword: str) -> list[str]:
    return re.findall("[a-z0-9]+", keyword.lower())


def coverage(title: Column, keyword: str) -> Column:
    """``Yes``, ``Partial`` or ``No`` for one keyword and a title.

    Yes: all words of the keyword occur in its order, other words may stand between.
    Partial: all occur, in another order.
    """
    words = _words(keyword)
    if not words:
        return F.lit("No")
    # Word borders are anything but a-z0-9, as in the split of the keyword.
    lowered = F.lower(F.coalesce(title, F.lit("")))

    def bounded(word: str) -> str:
        return rf"(?<![a-z0-9]){word}(?![a-z0-9])"

    # The first place of each word behind the last one settles the order, so no step is retried.
    in_order = lowered.rlike("(?s)^" + "".join(rf"(?>.*?{bounded(w)})" for w in words))
    # Which word comes how often does not matter here, only that each one occurs.
    all_there = F.lit(True)
    for word in dict.fromkeys(words):
        all_there = all_there & lowered.rlike(bounded(word))
    return F.when(in_order, F.lit("Yes")).when(all_there, F.lit("Partial")).otherwise(F.lit("No"))


def _per_keyword(
    listings: DataFrame, keep: Sequence[str], keywords: Sequence[str], make
) -> DataFrame:
    """One row per listing and keyword, the keywords being constants of the scan stage.

    A list too long for one expression is worked off in several passes over the listings.
    """
    if not keywords:
        raise ValueError("at least one keyword is needed")
    parts = []
    for first in range(0, len(keywords), KEYWORDS_PER_PASS):
        some = keywords[first : first + KEYWORDS_PER_PASS]
        cells = F.array(*(F.struct(F.lit(k).alias("keyword"), *make(k)) for k in some))
        parts.append(listings.select(*keep, F.inline(cells)))
    return reduce(DataFrame.unionAll, parts)


def keyword_coverage(
    listings: DataFrame, keywords: Sequence[str], title: str = "title",
    keep: Sequence[str] = ("listing_id",),
) -> DataFrame:
    """Coverage of every keyword by every title: ``keyword`` and ``coverage``.

    Nothing is joined or shuffled.
    """
    return _per_keyword(
        listings, keep, keywords, lambda k: [coverage(F.col(title), k).alias("coverage")]
    )


def _keyword_words(listings: DataFrame, keywords: Sequence[str] | DataFrame) -> DataFrame:
    """``keyword``, its ``words`` in order, and the longest one as ``key``."""
    if not isinstance(keywords, DataFrame):
        if not keywords:
            raise ValueError("at least one keyword is needed")
        keywords = listings.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
    words = F.regexp_extract_all(F.lower("keyword"), F.lit("([a-z0-9]+)"), F.lit(1))
    sized = F.transform("words", lambda w: F.struct(F.length(w).alias("size"), w.alias("word")))
    return keywords.select("keyword", words.alias("words")).where(F.size("words") > 0).withColumn(
        "key", F.array_max(sized)["word"]
    )


def keyword_hits(
    listings: DataFrame, keywords: Sequence[str] | DataFrame, title: str = "title",
    keep: Sequence[str] = ("listing_id",),
) -> DataFrame:
    """Only the pairs of title and keyword that are covered: ``keyword`` and ``coverage``.

    ``keywords`` is a list or a table with a ``keyword`` column, of any length. A title is split
    into words once and joined with the keywords on their longest word, so a keyword meets the
    titles that hold that word and no others. The rest of its words are then looked up, each
    behind the one before it.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(title), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    split = listings.select(*keep, tokens.alias("_tokens"))
    meeting = split.select("*", F.explode(F.array_distinct("_tokens")).alias("key")).join(
        _keyword_words(listings, keywords), "key"
    )
    there = F.forall("words", lambda w: F.array_contains(F.col("_tokens"), w))

    def behind(at: Column, word: Column) -> Column:
        rest = F.slice(F.col("_tokens"), at + 1, F.size("_tokens"))
        found = F.array_position(rest, word).cast("int")
        return F.when((at >= 0) & (found > 0), at + found).otherwise(F.lit(-1))

    in_order = F.aggregate("words", F.lit(0), behind) > 0
    return meeting.where(there).select(
        *keep, "keyword", F.when(in_order, F.lit("Yes")).otherwise(F.lit("Partial")).alias("coverage")
    )


def coverage_totals(
    listings: DataFrame, keywords: Sequence[str] | DataFrame, title: str = "title"
) -> DataFrame:
    """Titles per keyword and coverage; those without the keyword are the rest of all titles."""
    hits = ranking.counts(keyword_hits(listings, keywords, title, ()), "keyword", "coverage")
    names = keywords if isinstance(keywords, DataFrame) else listings.sparkSession.createDataFrame(
        [(k,) for k in keywords], "keyword string"
    )
    whole = listings.agg(F.count(F.lit(1))).scalar()
    covered = hits.groupBy("keyword").agg(F.sum("n").alias("covered"))
    rest = names.select("keyword").distinct().join(covered, "keyword", "left").select(
        "keyword", F.lit("No").alias("coverage"), (whole - F.coalesce("covered", F.lit(0))).alias("n")
    )
    return hits.unionByName(rest.where("n > 0"))


def matching_bullets(
    bullets: Column, keyword: str, generic: Sequence[str] = GENERIC_WORDS
) -> Column:
    """Numbers of the bullets that contain the stems of all telling words of the keyword."""
    stems = [w[:STEM_LENGTH] for w in _words(keyword) if w not in generic]
    if not stems:
        return F.array().cast("array<int>")

    def hit(bullet: Column) -> Column:
        found = F.lit(True)
        for stem in dict.fromkeys(stems):
            found = found & F.lower(bullet).rlike(rf"(?<![a-z0-9]){stem}")
        return found

    marks = F.transform(bullets, lambda b, i: F.when(hit(b), (i + 1).cast("int")))
    return F.coalesce(F.array_compact(marks), F.array().cast("array<int>"))


def keyword_placement(
    listings: DataFrame, keywords: Sequence[str], title: str = "title", bullets: str = "bullets",
    keep: Sequence[str] = ("listing_id",), generic: Sequence[str] = GENERIC_WORDS,
) -> DataFrame:
    """Where each keyword stands: in the title, in which bullets, and both as one text."""

    def places(keyword: str) -> list[Column]:
        in_title = coverage(F.col(title), keyword) == "Yes"
        numbers = matching_bullets(F.col(bullets), keyword, generic)
        names = F.transform(numbers, lambda n: F.concat(F.lit("Bullet "), n.cast("string")))
        return [
            in_title.alias("in_title"),
            numbers.alias("bullet_numbers"),
            F.array_join(
                F.concat(F.when(in_title, F.array(F.lit("Title"))).otherwise(
                    F.array().cast("array<string>")), names),
                " + ",
            ).alias("placement"),
        ]

    return _per_keyword(listings, keep, keywords, places)


def placement_counts(
    keywords: DataFrame, column: str = "Recommended Placement", separator: str = ";"
) -> DataFrame:
    """Keywords per recommended placement; one keyword may have several."""
    parts = F.transform(F.split(F.col(column), re.escape(separator)), lambda p: F.trim(p))
    named = F.filter(parts, lambda p: p != "")
    return ranking.count_elements(keywords, named, "placement")


def tier_counts(keywords: DataFrame, *columns: str) -> DataFrame:
    """Keywords per tier and priority, or per any other columns."""
    return ranking.counts(keywords, *(columns or ("Category", "Priority")))
