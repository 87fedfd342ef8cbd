"""Item ids and item fields out of a table of stored pages.

Every step works row by row inside the scan stage; only the ids of several pages taken
together need a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions import markup
from marketlens.functions.binding import let
from marketlens.operators import ranking

# Letters and digits as Python's isalpha() and isdigit() see them.
_ALNUM_START = r"^[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉]"


# --- item ids ------------------------------------------------------------------------


def item_links(links: Column, marks: Sequence[str] = fv.ITEM_LINK_MARKS) -> Column:
    """Links that contain one of the marks."""

    def wanted(link: Column) -> Column:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(link, F.lit(mark))
        return hit

    return F.filter(links, wanted)


def ids_from_segments(
    links: Column, length: int = fv.ID_LENGTH, marks: Sequence[str] = fv.ITEM_LINK_MARKS
) -> Column:
    """Path segments of item links with the length of an id and a letter or digit first."""
    segments = F.flatten(F.transform(item_links(links, marks), lambda link: F.split(link, "/")))
    fit = F.filter(segments, lambda s: (F.length(s) == length) & s.rlike(_ALNUM_START))
    return F.array_distinct(fit)


def ids_from_pattern(links: Column, pattern: str = fv.ID_PATTERN) -> Column:
    """Group 1 of the first match in each link, in link order."""
    found = F.transform(links, lambda link: F.regexp_extract(link, pattern, 1))
    return F.array_distinct(F.filter(found, lambda i: i != ""))


def ids_from_attribute(
    page: Column, attribute: str = "data-asin", length: int = fv.ID_LENGTH
) -> Column:
    """Attribute values with exactly the length of an id, in page order."""
    values = markup.attribute_values(page, attribute)
    return F.array_distinct(F.filter(values, lambda v: F.length(v) == length))


def ids_with_fallback(
    page: Column,
    attribute: str = "data-asin",
    length: int = fv.ID_LENGTH,
    pattern: str = fv.ID_PATTERN,
    minimum: int | None = None,
    cap: int | None = None,
) -> Column:
    """Attribute ids, then link ids.

    With ``minimum``, link ids follow only where there are fewer attribute ids than that; with
    ``cap``, only so many ids of a page are kept. Both drop ids, so neither is on by default;
    ``MIN_ATTRIBUTE_IDS`` and ``MAX_IDS_PER_PAGE`` are the crawler's values.
    """
    first = ids_from_attribute(page, attribute, length)
    both = F.array_distinct(F.concat(first, ids_from_pattern(markup.links(page), pattern)))
    ids = both if minimum is None else F.when(F.size(first) < minimum, both).otherwise(first)
    return _first_ones(ids, cap)


def _first_ones(ids: Column, cap: int | None) -> Column:
    return ids if cap is None else F.slice(ids, 1, cap)


def page_links(pages: DataFrame, keep: Sequence[str] = ("url",)) -> DataFrame:
    """One row per link: the kept columns, ``position`` from 1 and ``href``."""
    found = markup.links(markup.visible_markup(F.col("html")))
    return pages.select(*keep, F.posexplode(found).alias("position", "href")).withColumn(
        "position", F.col("position").cast("bigint") + 1
    )


def page_item_ids(
    pages: DataFrame,
    method: str = "attribute_then_links",
    keep: Sequence[str] = ("url",),
    skip_blocked: bool = False,
    cap: int | None = None,
    **options,
) -> DataFrame:
    """One row per page and id in page order: ``position``, ``ASIN`` and ``detail_url``.

    ``method`` is ``attribute_then_links``, ``attribute``, ``links`` or ``segments``.
    ``skip_blocked`` leaves out pages that ask for a captcha, as a crawler that reads pages one by
    one does; ``cap`` keeps the first ids of each page only.
    """
    page = markup.visible_markup(F.col("html"))
    if method == "attribute_then_links":
        ids = ids_with_fallback(page, cap=cap, **options)
    elif method == "attribute":
        ids = _first_ones(ids_from_attribute(page, **options), cap)
    elif method == "links":
        ids = _first_ones(ids_from_pattern(markup.links(page), **options), cap)
    elif method == "segments":
        ids = _first_ones(ids_from_segments(markup.links(page), **options), cap)
    else:
        raise ValueError(f"unknown method {method!r}")
    open_pages = pages.filter(~is_blocked(F.col("html"))) if skip_blocked else pages
    return open_pages.select(*keep, F.posexplode(ids).alias("position", "ASIN")).select(
        *keep,
        (F.col("position") + 1).cast("bigint").alias("position"),
        "ASIN",
        detail_url(F.col("ASIN")).alias("detail_url"),
    )


def distinct_ids(ids: DataFrame) -> DataFrame:
    """Each id once over all pages, in no particular order."""
    return ids.select("ASIN").distinct()


def detail_url(item_id: Column, prefix: str = fv.DETAIL_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), item_id)


# --- item fields ---------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """Where a field stands: start tags tried in turn, and its default.

    The first one with an element wins; with ``skip_empty``, the first whose element has
    text. ``remove`` is cut out of the text wherever it occurs.
    """

    starts: tuple[markup.StartTag, ...]
    default: str = fv.MISSING_TEXT
    skip_empty: bool = False
    remove: str = ""


def field_text(tree: Column, rule: FieldRule) -> Column:
    """Text of a field by its rule, or the rule's default, from a page's ``markup.parsed`` tree.

    Start tags are matched attribute by attribute, so a ``>`` or a name inside a quoted value
    changes nothing; an element ends with its end tag or with an element around it.
    """
    tries = []
    for start in rule.starts:
        found = markup.tokens_text(markup.element_tokens(tree, start))
        # named, so that the test for an empty text does not find it anew
        tries.append(let(found, lambda text: F.when(text != "", text)) if rule.skip_empty else found)
    value = F.coalesce(*tries, F.lit(rule.default))
    return F.replace(value, F.lit(rule.remove), F.lit("")) if rule.remove else value


def page_fields(
    pages: DataFrame, rules: Mapping[str, FieldRule], keep: Sequence[str] = ("url",)
) -> DataFrame:
    """One row per page with the kept columns and one text column per rule."""
    tree = F.col("_tree")
    with_tree = pages.withColumn("_tree", markup.parsed(markup.visible_markup(F.col("html"))))
    return with_tree.select(
        *keep, *(field_text(tree, rule).alias(name) for name, rule in rules.items())
    )


_START = markup.open_tag
_OFFSCREEN = _START(classes=("a-offscreen",))
_STARS = _START("span", classes=("a-icon-alt",))
_REVIEW_TOTAL = _START("span", element_id="acrCustomerReviewText")

# Rules of the full detail table; price and sales rank have rules of their own below.
DETAIL_RULES: dict[str, FieldRule] = {
    "Title": FieldRule((_START("span", element_id="productTitle"),)),
    "Rating": FieldRule((_STARS,), default="0"),
    "Reviews": FieldRule((_REVIEW_TOTAL,), default="0"),
    "Brand": FieldRule((_START("a", element_id="bylineInfo"),), remove=fv.BRAND_PREFIX),
}

# Rules of the short detail table.
QUICK_RULES: dict[str, FieldRule] = {
    "Title": FieldRule(
        tuple(_START(element_id=i) for i in ("productTitle", "title", "title_feature_div"))
    ),
    "Price": FieldRule(
        (
            _START(element_id="price_inside_buybox"),
            _START(element_id="priceblock_ourprice"),
            _START(classes=("a-price", "a-text-price", "a-size-medium", "apexPriceToPay")),
            _OFFSCREEN,
        ),
        skip_empty=True,
    ),
    "Rating": FieldRule((_START("i", attributes={"data-hook": "average-star-rating"}), _STARS)),
    "Reviews": FieldRule(
        (_START("span", attributes={"data-hook": "total-review-count"}), _REVIEW_TOTAL)
    ),
}


def price_text(tree: Column) -> Column:
    """Whole and fraction part joined, else the off-screen price, else the default."""

    def text_of(css_class: str) -> Column:
        return markup.tokens_text(markup.element_tokens(tree, _START("span", classes=(css_class,))))

    whole, fraction = text_of("a-price-whole"), text_of("a-price-fraction")
    joined = F.concat(whole, F.coalesce(fraction, F.lit("")))
    return F.coalesce(joined, text_of("a-offscreen"), F.lit(fv.MISSING_TEXT))


_RANK_SPAN = rf"<(?i:span)\b[^>]*>{fv.RANK_LABEL}</(?i:span)\s*>"
_RANK_CELL = (
    rf"<(?i:td)\b[^>]*>(?:<[a-zA-Z][^>]*>)*+[^<]*{fv.RANK_LABEL}[^<]*(?:</(?!(?i:td)[\s>])[^>]*>)*+</(?i:td)\s*>"
)
# What follows the label up to the next start tag, and that tag; elements balance from there.
_AFTER_LABEL = markup.StartTag(
    rf"{_RANK_SPAN}(?>(?s:.*?)<(?=[a-zA-Z]))([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>", (fv.RANK_LABEL,)
)


def rank_text(page: Column) -> Column:
    """Sales rank digits from beside the rank label, or the default.

    A label in a span is followed by an element with the rank; a label in a table cell
    shares its row with the rank.
    """
    row = F.element_at(
        F.filter(F.split(page, r"(?i)<tr(?=[\s>])"), lambda piece: piece.rlike(_RANK_CELL)), 1
    )
    row_inner = F.regexp_extract(row, r"(?is)^[^>]*>(.*?)(?:</tr\s*>|\z)", 1)
    beside = (
        F.when(~F.contains(page, F.lit(fv.RANK_LABEL)), F.lit(""))
        .when(page.rlike(_RANK_SPAN), F.coalesce(markup.element_markup(page, _AFTER_LABEL), F.lit("")))
        .when(page.rlike(_RANK_CELL), row_inner)
        .otherwise(F.lit(""))
    )
    number = F.regexp_extract(markup.joined_text(beside), "#?[0-9,]+", 0)
    return F.when(number == "", F.lit(fv.MISSING_TEXT)).otherwise(F.translate(number, "#,", ""))


def _rank_unreadable(page: Column) -> Column:
    """The label stands in a span after which the page has no further element."""
    dangling = page.rlike(rf"{_RANK_SPAN}(?!(?s:.*?)<[a-zA-Z])")
    return F.contains(page, F.lit(fv.RANK_LABEL)) & dangling


# --- status --------------------------------------------------------------------------


def is_blocked(html: Column, phrases: Sequence[str] = fv.BLOCK_PHRASES) -> Column:
    """True for a page that asks for a captcha instead of showing content, and for none."""
    lowered = F.lower(html)
    hit = html.isNull()
    for phrase in phrases:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return F.coalesce(hit, F.lit(True))


def blocked_rate(pages: DataFrame, phrases: Sequence[str] = fv.BLOCK_PHRASES) -> DataFrame:
    """Pages, blocked pages and their share, in one row."""
    blocked = is_blocked(F.col("html"), phrases)
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(blocked).alias("blocked"),
        F.coalesce(F.avg(blocked.cast("double")), F.lit(0.0)).alias("blocked_rate"),
    )


def product_details(pages: DataFrame, item_id: Column) -> DataFrame:
    """The full detail table: id, fields and ``Status`` for every page.

    A blocked or absent page keeps its id and status only. A page whose rank label leads
    nowhere has a parse error and no rank.
    """
    page, tree = F.col("_page"), F.col("_tree")
    read = pages.select(
        item_id.alias("ASIN"),
        is_blocked(F.col("html")).alias("_blocked"),
        markup.visible_markup(F.col("html")).alias("_page"),
    ).withColumn("_tree", markup.parsed(F.col("_page")))

    def unless_blocked(value: Column) -> Column:
        return F.when(~F.col("_blocked"), value)

    broken = F.col("_broken")
    # the generator keeps the test from being built into both columns that use it
    read = read.select("*", F.explode(F.array(_rank_unreadable(page))).alias("_broken"))
    return read.select(
        "ASIN",
        unless_blocked(field_text(tree, DETAIL_RULES["Title"])).alias("Title"),
        unless_blocked(price_text(tree)).alias("Price"),
        *(
            unless_blocked(field_text(tree, DETAIL_RULES[name])).alias(name)
            for name in ("Rating", "Reviews", "Brand")
        ),
        F.when(~F.col("_blocked") & ~broken, rank_text(page)).alias("BSR"),
        F.when(F.col("_blocked"), F.lit(fv.STATUS_NOT_FETCHED))
        .when(broken, F.lit(fv.STATUS_PARSE_ERROR))
        .otherwise(F.lit(fv.STATUS_OK))
        .alias("Status"),
    )


def quick_details(
    pages: DataFrame, item_id: Column, response_code: Column | None = None
) -> DataFrame:
    """The short detail table: id, four fields, ``URL``, and ``Error`` on failed rows.

    ``response_code`` is the stored HTTP status, where there is one; a page that is
    absent is an error too. This table does not test for blocked pages.
    """
    code = F.lit(200) if response_code is None else response_code
    tree = F.col("_tree")
    read = pages.select(
        item_id.alias("ASIN"),
        F.when(code != 200, F.concat(F.lit("Status "), code.cast("string")))
        .when(F.col("html").isNull(), F.lit("no page"))
        .alias("Error"),
        markup.parsed(markup.visible_markup(F.col("html"))).alias("_tree"),
    )
    fine = F.col("Error").isNull()
    return read.select(
        "ASIN",
        *(
            F.when(fine, field_text(tree, rule)).alias(name)
            for name, rule in QUICK_RULES.items()
        ),
        F.when(fine, detail_url(F.col("ASIN"))).alias("URL"),
        "Error",
    )


def status_counts(details: DataFrame) -> DataFrame:
    """Rows per status; those with the success status are the valid results."""
    return ranking.counts(details, "Status")


def without_errors(details: DataFrame) -> DataFrame:
    """Rows that were fetched, without the ``Error`` column."""
    return details.filter(F.col("Error").isNull()).drop("Error")
