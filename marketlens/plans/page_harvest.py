"""Stored ranking pages and item pages to a product table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.operators import pages


def wanted_items(
    ranking_pages: DataFrame, method: str = "attribute_then_links", **options
) -> DataFrame:
    """Each item id of the ranking pages once, with the URL of its page.

    ``options`` go to ``page_item_ids``: caps, thresholds and the blocked-page test are off
    unless they are named here.
    """
    ids = pages.distinct_ids(pages.page_item_ids(ranking_pages, method, **options))
    return ids.withColumn("detail_url", pages.detail_url(F.col("ASIN")))


def harvest(
    ranking_pages: DataFrame, item_pages: DataFrame, method: str = "attribute_then_links", **options
) -> DataFrame:
    """The detail table of all items on the ranking pages, one row per item.

    Only stored pages of wanted items are parsed: a semi-join on the url comes first. A page
    stored several times is parsed copy by copy in the scan stage, and the best copy, a readable
    one before a blocked one, is picked among hashes of the parsed copies, which are merged in each
    task before they meet. An item whose page is not stored keeps a row with its id and the failure
    status.
    """
    items = wanted_items(ranking_pages, method, **options)
    wanted = item_pages.join(items.select(F.col("detail_url").alias("url")), "url", "left_semi")
    read = pages.product_details(wanted.select("url", "html"), F.col("url")).withColumnRenamed("ASIN", "detail_url")
    fields = [c for c in read.columns if c not in ("detail_url", "Status")]
    preference = F.when(F.col("Status") == fv.STATUS_OK, 0).when(
        F.col("Status") == fv.STATUS_PARSE_ERROR, 1
    ).otherwise(2)
    # two numbers decide, so the copies' fields stay out of the comparison
    place = F.struct(preference.alias("preference"), F.xxhash64(*fields).alias("hash"))
    one_each = read.groupBy("detail_url").agg(
        F.min_by(F.struct(*fields, "Status"), place).alias("page")
    )
    status = F.coalesce(F.col("page.Status"), F.lit(fv.STATUS_NOT_FETCHED))
    return items.join(one_each, "detail_url", "left").select(
        "ASIN", *(F.col(f"page.{name}").alias(name) for name in fields), status.alias("Status")
    )


def failures(details: DataFrame) -> DataFrame:
    """Items without details and why."""
    return details.filter(F.col("Status") != fv.STATUS_OK).select("ASIN", "Status")
