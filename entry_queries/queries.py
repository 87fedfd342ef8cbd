"""One DataFrame query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries import roles
from entry_queries.roles import dealt, table
from marketlens import fixed_values as fv
from marketlens.functions import markup, numbers, text
from marketlens.operators import keywords, pages, products, reviews, summary
from marketlens.plans import page_harvest, review_report
from marketlens.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.tag_reviews(roles.raw_reviews(spark, sf_dir), roles.LETTER_SHARE)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.kept_reviews(_tagged(spark, sf_dir))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.enrich_reviews(_cleaned(spark, sf_dir), roles.LEXICON)


# --- text and number functions -------------------------------------------------------


@query
def mojibake_repair(spark, sf_dir):
    once = roles.damaged(F.col("text"))
    return dealt(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.md5(text.repair_encoding(once)).alias("once_md5"),
        F.md5(text.repair_encoding(roles.damaged(once))).alias("twice_md5"),
    )


@query
def garbled_flag(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select(
        "doc_id",
        text.is_garbled(roles.damaged(F.col("text"))).alias("damaged_is_garbled"),
        text.is_garbled(F.col("text")).alias("text_is_garbled"),
    )


@query
def ascii_letter_ratio(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.round(text.ascii_letter_share(F.col("text")), 6).alias("share"),
        text.is_mostly_english(F.col("text"), roles.LETTER_SHARE).alias("mostly_english"),
    )


@query
def rating_parse(spark, sf_dir):
    stars = F.concat(F.lit("rated "), F.col("l_quantity").cast("string"), F.lit(" of 50, not 99"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.rating_value(stars).alias("rating")
    )


@query
def helpful_count(spark, sf_dir):
    size = F.col("p_size")
    said = F.when(size == 1, F.lit("One person found this helpful")).otherwise(
        F.concat(size.cast("string"), F.lit(" people found this helpful"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", numbers.first_integer(said).alias("helpful_count")
    )


@query
def price_parse(spark, sf_dir):
    shown = F.concat(F.lit("SGD "), F.format_number("l_extendedprice", 2), F.lit(" each"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.price_value(shown).alias("price")
    )


@query
def numeric_coerce(spark, sf_dir):
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    mixed = (
        F.when(kind == "MEDIUM", F.concat(F.lit(" "), size))
        .when(kind == "STANDARD", F.concat(size, F.lit(".9")))
        .when(kind == "LARGE", F.concat(F.lit("-"), size, F.lit(".9")))
        .when(kind == "PROMO", F.concat(size, F.lit(" ratings")))
        .when(kind == "SMALL", F.concat(size, F.lit("d")))
        .otherwise(F.concat(F.lit("1,"), size))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        numbers.numeric_or_null(mixed).alias("number"),
        numbers.whole_number_or_null(mixed).alias("whole"),
    )


# --- reviews -------------------------------------------------------------------------


@query
def drop_reasons(spark, sf_dir):
    return reviews.drop_counts(_tagged(spark, sf_dir))


@query
def clean_reviews(spark, sf_dir):
    return _cleaned(spark, sf_dir)


@query
def top_words_positive(spark, sf_dir):
    return reviews.top_words(_enriched(spark, sf_dir), "positive")


@query
def top_words_negative(spark, sf_dir):
    return reviews.top_words(_enriched(spark, sf_dir), "negative")


@query
def top_bigrams_positive(spark, sf_dir):
    return reviews.top_ngrams(_enriched(spark, sf_dir), "positive")


@query
def top_bigrams_negative(spark, sf_dir):
    return reviews.top_ngrams(_enriched(spark, sf_dir), "negative")


@query
def theme_counts(spark, sf_dir):
    return reviews.theme_counts(_enriched(spark, sf_dir))


@query
def theme_polarity(spark, sf_dir):
    return reviews.theme_polarity(_enriched(spark, sf_dir))


@query
def review_stats(spark, sf_dir):
    return reviews.review_stats(_cleaned(spark, sf_dir))


@query
def rating_distribution(spark, sf_dir):
    return reviews.rating_distribution(_cleaned(spark, sf_dir))


@query
def length_by_rating(spark, sf_dir):
    return reviews.length_by_rating(_cleaned(spark, sf_dir))


@query
def crawl_coverage(spark, sf_dir):
    return reviews.crawl_coverage(roles.crawl_log(spark, sf_dir))


@query
def status_top5(spark, sf_dir):
    return reviews.top_status_traces(roles.crawl_log(spark, sf_dir))


def _summary(spark, sf_dir):
    staged = review_report.staged_reviews(
        roles.raw_reviews(spark, sf_dir), roles.LETTER_SHARE, roles.LEXICON,
        columns=review_report.STATISTIC_COLUMNS,
    )
    return review_report.summary_of(staged, roles.crawl_log(spark, sf_dir))


@query
def review_summary(spark, sf_dir):
    """The summary record, one row per number or list entry."""
    return _summary_entries(_summary(spark, sf_dir))


@query
def summary_json(spark, sf_dir):
    """The JSON document of the summary, read back from its text, one row per number or entry."""
    record = _summary(spark, sf_dir)
    document = writers.to_json_text(record)
    return _summary_entries(
        document.select(F.from_json("value", record.schema).alias("r")).select("r.*")
    )


def _summary_entries(record: DataFrame) -> DataFrame:
    def entries(section: str, key, value, items):
        return F.transform(
            items,
            lambda e: F.struct(
                F.lit(section).alias("section"), key(e).alias("name"),
                value(e).cast("double").alias("value"),
            ),
        )

    def of_map(section: str):
        return entries(
            section, lambda e: e["key"], lambda e: e["value"], F.map_entries(section)
        )

    def of_list(section: str):
        return entries(section, lambda e: e["term"], lambda e: e["n"], F.col(section))

    def of_struct(section: str, names):
        return F.array(
            *(F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"),
                       F.col(section)[n].cast("double").alias("value")) for n in names)
        )

    def of_names(names: str):
        return F.transform(
            F.col("headline")[names],
            lambda name, i: F.struct(
                F.lit(f"headline_{names}").alias("section"), name.alias("name"),
                (i + 1).cast("double").alias("value"),
            ),
        )

    stats = record.schema["review_stats"].dataType.names
    crawl = [n for n in record.schema["crawl_status"].dataType.names if n != "status_trace_top"]
    return record.select(
        F.inline(
            F.concat(
                of_struct("review_stats", stats),
                of_struct("crawl_status", crawl),
                of_struct("cleaning_filters", [fv.EMPTY_REVIEW, fv.UNREADABLE_REVIEW]),
                of_map("rating_distribution"),
                of_map("rating_length_summary"),
                of_map("painpoint_counts"),
                entries("status_trace_top", lambda e: e["key"], lambda e: e["value"],
                        F.map_entries(F.col("crawl_status.status_trace_top"))),
                *(of_list(f"{side}_top_{kind}")
                  for side in summary.SIDES for kind in ("words", "bigrams")),
                *(of_names(n) for n in ("positive_words", "negative_words", "themes")),
            )
        )
    )


# --- products ------------------------------------------------------------------------


@query
def product_filter(spark, sf_dir):
    found = products.priced_products(roles.products(spark, sf_dir), roles.MODEL)
    return found.select("ASIN", "Title", "Price", "Brand", "Price_Clean", "Title_Lower")


@query
def product_filter_counts(spark, sf_dir):
    return products.product_counts(roles.products(spark, sf_dir), roles.MODEL)


@query
def scatter_points(spark, sf_dir):
    priced = products.with_price(roles.products(spark, sf_dir))
    return products.rating_scatter(priced)


@query
def scatter_points_extracted(spark, sf_dir):
    priced = products.with_price(roles.products(spark, sf_dir))
    return products.rating_scatter(priced, strict=False)


@query
def price_histogram(spark, sf_dir):
    return products.price_histogram(roles.priced_lines(spark, sf_dir)).select(
        "bin", F.round("left_edge", 4).alias("left_edge"),
        F.round("right_edge", 4).alias("right_edge"), "n",
    )


def _rounded_density(priced: DataFrame, merge_equal: bool = True) -> DataFrame:
    return products.price_density(priced, merge_equal=merge_equal).select(
        "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"),
        F.round("scaled", 4).alias("scaled"),
    )


@query
def price_density(spark, sf_dir):
    return _rounded_density(roles.priced_parts(spark, sf_dir))


@query
def value_density(spark, sf_dir):
    return _rounded_density(roles.priced_events(spark, sf_dir), merge_equal=False)


@query
def brand_top10(spark, sf_dir):
    return products.top_brands(roles.priced_parts(spark, sf_dir))


def _rounded_box(priced: DataFrame) -> DataFrame:
    four = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return products.brand_box(priced).select(
        "Brand", "n", *(F.round(c, 4).alias(c) for c in four), "outliers"
    )


@query
def brand_box_top5(spark, sf_dir):
    return _rounded_box(roles.priced_parts(spark, sf_dir))


@query
def line_price_box(spark, sf_dir):
    return _rounded_box(roles.priced_lines(spark, sf_dir))


@query
def value_box(spark, sf_dir):
    return _rounded_box(roles.priced_events(spark, sf_dir))


@query
def value_outliers(spark, sf_dir):
    return products.brand_outliers(roles.priced_events(spark, sf_dir))


@query
def price_band_share(spark, sf_dir):
    return products.price_band_share(roles.priced_lines(spark, sf_dir), 5_000.0, 20_000.0).select(
        "products", "in_band", F.round("share", 6).alias("share")
    )


@query
def brand_share(spark, sf_dir):
    return products.brand_shares(roles.priced_parts(spark, sf_dir)).select(
        "Brand", "n", F.round("share", 6).alias("share")
    )


# --- pages ---------------------------------------------------------------------------


@query
def page_links(spark, sf_dir):
    return pages.page_links(dealt(table(spark, sf_dir, "pages")), ["page_id"])


@query
def page_ids_fallback(spark, sf_dir):
    ids = pages.page_item_ids(
        dealt(table(spark, sf_dir, "pages")), keep=["page_id"],
        attribute="href", length=4, pattern="/([a-z]{2})", minimum=2, cap=5,
    )
    return ids


@query
def page_ids_all(spark, sf_dir):
    """All ids by attribute and by link, without caps or thresholds."""
    return pages.page_item_ids(
        table(spark, sf_dir, "pages"), keep=["page_id"],
        attribute="href", length=4, pattern="/([a-z]{2})",
    )


@query
def page_ids_distinct(spark, sf_dir):
    ids = pages.page_item_ids(
        dealt(table(spark, sf_dir, "pages")), "links", keep=["page_id"], pattern="/([a-z]{3})"
    )
    return pages.distinct_ids(ids)


@query
def page_ids_segments(spark, sf_dir):
    return pages.page_item_ids(
        dealt(table(spark, sf_dir, "pages")), "segments", keep=["page_id"], length=5, marks=("/",)
    )


@query
def page_fields(spark, sf_dir):
    tag = markup.open_tag
    rules = {
        "title": pages.FieldRule((tag("title"),)),
        "heading": pages.FieldRule((tag("h2"), tag("h1")), skip_empty=True),
        "ad": pages.FieldRule((tag(classes=("ad",)),)),
        "footer": pages.FieldRule((tag("footer"),)),
        "list": pages.FieldRule((tag("ul"),)),
        "aside": pages.FieldRule((tag("aside"),)),
    }
    return pages.page_fields(dealt(table(spark, sf_dir, "pages")), rules, ["page_id"])


@query
def page_status(spark, sf_dir):
    stored = dealt(table(spark, sf_dir, "pages"))
    blocked = pages.is_blocked(F.col("html"), ('lang="de"', "nicht aulich"))
    return stored.select(
        "page_id",
        F.when(blocked, fv.STATUS_NOT_FETCHED).otherwise(fv.STATUS_OK).alias("status"),
    )


@query
def blocked_rate(spark, sf_dir):
    return pages.blocked_rate(dealt(table(spark, sf_dir, "pages")), ("nicht aulich",)).select(
        "pages", "blocked", F.round("blocked_rate", 6).alias("blocked_rate")
    )


@query
def item_details(spark, sf_dir):
    return pages.product_details(roles.item_pages(spark, sf_dir), F.col("item"))


@query
def item_harvest(spark, sf_dir):
    stored = roles.item_pages(spark, sf_dir).select(
        pages.detail_url(F.col("item")).alias("url"), "html"
    )
    return page_harvest.harvest(roles.ranking_pages(spark, sf_dir), stored)


@query
def item_status_counts(spark, sf_dir):
    details = pages.product_details(roles.item_pages(spark, sf_dir), F.col("item"))
    return pages.status_counts(details)


@query
def item_details_quick(spark, sf_dir):
    return pages.without_errors(
        pages.quick_details(roles.item_pages(spark, sf_dir), F.col("item"))
    )


@query
def item_details_union(spark, sf_dir):
    """Fetched rows and failed rows as two tables of different width, put together."""
    details = pages.quick_details(roles.item_pages(spark, sf_dir), F.col("item"))
    failed = details.filter(F.col("Error").isNotNull()).select("ASIN", "Error")
    return writers.union_ragged(pages.without_errors(details), failed).select(
        "ASIN", "Title", "Rating", "Error"
    )


# --- keywords ------------------------------------------------------------------------


def _page_listings(spark, sf_dir):
    """Pages as listings: the title, and the text of each paragraph as a bullet."""
    page = markup.visible_markup(F.col("html"))
    # from each start tag to the next one or the end tag: unclosed paragraphs end there too
    whole = r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p\s*>|<p[\s>]|</article|\z)"
    paragraphs = F.transform(F.regexp_extract_all(page, F.lit(whole), F.lit(1)), markup.node_text)
    return dealt(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("listing_id"),
        markup.node_text(markup.element_markup(page, markup.open_tag("title"))).alias("title"),
        paragraphs.alias("bullets"),
    )


@query
def keyword_coverage(spark, sf_dir):
    return keywords.keyword_coverage(_page_listings(spark, sf_dir), roles.KEYWORDS)


@query
def keyword_coverage_totals(spark, sf_dir):
    return keywords.coverage_totals(_page_listings(spark, sf_dir), roles.KEYWORDS)


@query
def keyword_hits(spark, sf_dir):
    return keywords.keyword_hits(_page_listings(spark, sf_dir), roles.KEYWORDS)


@query
def keyword_placement(spark, sf_dir):
    return keywords.keyword_placement(_page_listings(spark, sf_dir), roles.KEYWORDS).select(
        "listing_id", "keyword", "in_title", "placement"
    )


@query
def placement_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.concat_ws("; ", F.split("p_name", " ")).alias("Recommended Placement")
    )
    return keywords.placement_counts(parts)


@query
def keyword_tiers(spark, sf_dir):
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("Category"),
        F.when(size <= 10, "Low").when(size <= 30, "Medium").otherwise("High").alias("Priority"),
    )
    return keywords.tier_counts(parts)
