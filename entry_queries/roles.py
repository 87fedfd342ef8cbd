"""The given tables in the roles of reviews, crawl log, products and item pages.

Whole tables throughout. Reviews get damaged encodings and unreadable or empty texts by
source, so that repair and filters have something to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import readers

UNREADABLE_SOURCE = "src3"
EMPTY_SOURCE = "src5"
LETTER_SHARE = 0.9
LEXICON = {"ther": ("ther", "whether", "xyzzy"), "tion": ("tion",), "rewh": ("rewh", "etwas")}
MODEL = r"red\s*widget"
KEYWORDS = ("of the", "and that", "the on", "der", "les de")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as ``spark.marketlens.inputPartitions`` asks for, if it is set.

    For single small files, as in the bench; without the setting nothing is shuffled.
    """
    asked = rows.sparkSession.conf.get("spark.marketlens.inputPartitions", None)
    return readers.spread(rows, int(asked) if asked else None)


def dealt_rows(rows: DataFrame) -> DataFrame:
    """Rows that are about to become pages, dealt over the session's tasks even without the setting.

    A part takes some ten bytes of its file and a thousand as a page, so splits by file size give
    all pages of a large table to a few tasks.
    """
    conf = rows.sparkSession.conf
    asked = conf.get("spark.marketlens.inputPartitions", None)
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return readers.spread(rows, int(asked) if asked else tasks)


def damaged(text: Column) -> Column:
    """UTF-8 bytes read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    source, text = F.col("source"), F.col("text")
    return dealt(documents).join(labels, "doc_id", "left").select(
        source.alias("ASIN"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.lit("1").alias("review_page"),
        F.concat(F.lit(" About  "), F.col("lang")).alias("review_title"),
        F.when(F.col("quality") == 1, "5.0 out of 5 stars")
        .when(F.col("quality") == 0, "1.0 out of 5 stars")
        .alias("review_rating_text"),
        F.lit("Reviewed in 2024").alias("review_date"),
        F.when(source == UNREADABLE_SOURCE, F.concat(text, F.lit(" Ø")))
        .when(source == EMPTY_SOURCE, F.lit(" \n "))
        .otherwise(damaged(text))
        .alias("review_text"),
        F.concat((F.col("n_chars") % 50).cast("string"), F.lit(" people found this helpful")).alias(
            "helpful_text"
        ),
        F.when(F.col("toxic") == 0, "Yes").otherwise("no").alias("is_verified_purchase"),
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "error", " YES ").otherwise("no").alias("is_captcha"),
        F.when(kind != "signup", kind).alias("status_trace"),
        F.when(kind == "click", F.lit("n/a")).otherwise(value.cast("string")).alias("review_count"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: upper-case titles, formatted prices, size 7 without a price."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ASIN"),
        F.upper("p_name").alias("Title"),
        F.when(size != 7, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).alias("Price"),
        F.concat((size % 5 + 1).cast("string"), F.lit(".0 out of 5 stars")).alias("Rating"),
        F.when(F.col("p_type") == "PROMO", F.concat(size.cast("string"), F.lit(" ratings")))
        .otherwise(size.cast("string"))
        .alias("Reviews"),
        F.col("p_brand").alias("Brand"),
    )


def priced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("Brand"), F.col("p_retailprice").alias("Price_Clean")
    )


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("Brand"), F.col("l_extendedprice").alias("Price_Clean")
    )


def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Brand"), F.col("value").alias("Price_Clean")
    )


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item page per part. Sizes 1 to 4 give blocked, absent and incomplete pages."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")

    def unless(which: int, markup: Column) -> Column:
        return F.when(size == which, F.lit("")).otherwise(markup)

    html = F.concat(
        F.lit("<html><head><script>var a='<span id=\"productTitle\">no</span>'</script></head>"),
        F.when(size == 1, F.lit("<p>Enter the CAPTCHA below</p>")).otherwise(F.lit("")),
        F.lit('<!-- <span class="a-offscreen">$0.00</span> --><div id="title_feature_div"><div>'),
        unless(3, F.concat(F.lit('<h1 id="title"><span class="x" id="productTitle"> \n'),
                           F.col("p_name"), F.lit(" <b>&amp; more</b> </span></h1>"))),
        F.lit("</div></div><a id='bylineInfo' href='#'>Brand: "), F.col("p_brand"), F.lit("</a>"),
        F.lit('<span class="a-price a-text-price a-size-medium apexPriceToPay">'),
        F.lit('<span class="a-offscreen">$'), price, F.lit("</span><span>now</span></span>"),
        unless(4, F.concat(
            F.lit('<span class="a-price-whole">'), F.substring_index(price, ".", 1),
            F.lit('<span class="a-price-decimal">.</span></span><span class="a-price-fraction">'),
            F.substring_index(price, ".", -1), F.lit("</span>"))),
        F.lit('<i data-hook="average-star-rating"><span class="a-icon-alt">'),
        (size % 5 + 1).cast("string"), F.lit(".0 out of 5 stars</span></i>"),
        F.lit('<span id="acrCustomerReviewText">'), size.cast("string"), F.lit(" ratings</span>"),
        F.lit("<table><tr><th><span>Best Sellers Rank</span></th>"),
        unless(4, F.concat(F.lit("<td><span>#1,"), key, F.lit("</span> in Cases (See Top)</td>"))),
        F.lit("</tr></table></html>"),
    )
    return dealt_rows(table(spark, sf_dir, "part")).select(
        F.lpad(key, 10, "B").alias("item"), F.when(size != 2, html).alias("html")
    )


def ranking_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking page per part, which lists the part and the one with the next key."""
    key = F.col("p_partkey")

    def item(number: Column) -> Column:
        return F.concat(
            F.lit('<li class="x" data-asin="'), F.lpad(number.cast("string"), 10, "B"),
            F.lit('">item</li>'),
        )

    return dealt_rows(table(spark, sf_dir, "part")).select(
        F.concat(F.lit("/top/"), key.cast("string")).alias("url"),
        F.concat(F.lit("<ul>"), item(key), item(key + 1), F.lit("</ul>")).alias("html"),
    )
