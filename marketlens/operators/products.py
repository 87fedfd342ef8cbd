"""Product filters and the data behind price and brand charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from marketlens import fixed_values as fv
from marketlens.functions import numbers
from marketlens.operators import ranking
from marketlens.operators.quantiles import MAX_BROADCAST_GROUPS, exact_quantiles


def with_price(products: DataFrame) -> DataFrame:
    """Add ``Price_Clean`` (number or null) and ``Title_Lower``.

    A price that is a number already keeps its size; a sign is not part of a price.
    """
    price = F.col("Price")
    if isinstance(products.schema["Price"].dataType, NumericType):
        number = F.abs(price.cast("double"))
        clean = F.when(~F.isnan(number), number)
    else:
        clean = numbers.price_value(price)
    return products.withColumns({"Price_Clean": clean, "Title_Lower": F.lower("Title")})


def matching_products(products: DataFrame, pattern: str = fv.MODEL_PATTERN) -> DataFrame:
    """Products whose lower-cased title holds ``pattern``; a null title does not.

    Classes such as ``\\s`` in the pattern cover all of Unicode, so a hard blank is one.
    """
    return with_price(products).filter(F.col("Title_Lower").rlike(f"(?U){pattern}"))


def priced_products(products: DataFrame, pattern: str = fv.MODEL_PATTERN) -> DataFrame:
    """Matching products that have a price."""
    return matching_products(products, pattern).dropna(subset=["Price_Clean"])


def product_counts(products: DataFrame, pattern: str = fv.MODEL_PATTERN) -> DataFrame:
    """Matching products found, dropped for want of a price, and kept, in one row."""
    price = F.col("Price_Clean")
    return matching_products(products, pattern).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(price.isNull()).alias("dropped"),
        F.count_if(price.isNotNull()).alias("kept"),
    )


def rating_scatter(priced: DataFrame, strict: bool = True) -> DataFrame:
    """Review count, rating and price per product.

    ``strict`` reads only cells that are numbers as a whole and leaves the rating as it
    is; otherwise the first number of each text is taken.
    """
    if strict:
        reviews, rating = numbers.numeric_or_null(F.col("Reviews")), F.col("Rating")
    else:
        reviews = numbers.price_value(F.col("Reviews"))
        rating = numbers.rating_value(F.col("Rating").cast("string"))
    return priced.select(
        reviews.alias("Reviews_Clean"), rating.alias("Rating"), "Price_Clean"
    )


def price_histogram(table: DataFrame, value: str = "Price_Clean", bins: int = 10) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value.

    A bin holds its left edge, the last one both edges. Equal values throughout get a range
    of one around them. Values that are no finite numbers don't count. Empty bins are listed. The range is a scalar subquery, and each
    task reduces its rows to at most ``bins`` counts before the shuffle.
    """
    v = F.col(value).cast("double")
    values = table.filter(F.abs(v) < float("inf")).select(v.alias("v"))
    ends = ranking.first_row(
        values.agg(F.min("v").alias("a"), F.max("v").alias("b")).select(
            F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
            F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
        ),
        ["lo", "hi"],
    )
    lo, hi = F.col("_ends")["lo"], F.col("_ends")["hi"]
    step = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(lo + i * step)

    # The quotient may be off by one next to an edge; the edges themselves decide.
    guess = F.greatest(
        F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)), F.lit(0)
    ).cast("int")
    located = (
        values.withColumn("_ends", ends)
        .withColumn("_guess", guess)
        .select(
            F.when(F.col("v") < edge(F.col("_guess")), F.col("_guess") - 1)
            .when(
                (F.col("_guess") < bins - 1) & (F.col("v") >= edge(F.col("_guess") + 1)),
                F.col("_guess") + 1,
            )
            .otherwise(F.col("_guess"))
            .alias("bin")
        )
    )
    counted = ranking.counts(located, "bin")
    all_bins = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(counted, "bin", "left")
        .withColumn("_ends", ends)
        .filter(lo.isNotNull())
        .select(
            (F.col("bin") + 1).cast("bigint").alias("bin"),
            edge(F.col("bin")).alias("left_edge"),
            edge(F.col("bin") + 1).alias("right_edge"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
    )


def price_density(
    table: DataFrame, value: str = "Price_Clean", points: int = 200, bins: int = 10,
    merge_equal: bool = True,
) -> DataFrame:
    """Gaussian kernel density of the values on an even grid from minimum to maximum.

    The bandwidth is the sample deviation times n^(-1/5). With ``merge_equal``, equal values are
    brought together first, so the work follows the distinct values, which pays for prices in
    cents; without it each task sums up its grid points straight from the scan, which pays where
    few values are equal. Values that are no finite numbers don't count. Each value visits only grid points within 39
    bandwidths, beyond which the kernel is zero in double precision; that keeps the sum
    whole while the visited part shrinks as n grows. ``scaled`` is the curve in units of
    the histogram with ``bins`` bins. No spread gives no rows.
    """
    v = F.col(value).cast("double")
    values = table.filter(F.abs(v) < float("inf")).select(v.alias("v"))
    stats = ranking.first_row(
        values.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.stddev_samp("v").alias("sd"),
        ),
        ["n", "lo", "hi", "sd"],
    )
    n, lo, hi = (F.col("_s")[c] for c in ("n", "lo", "hi"))
    width = F.col("_s")["sd"] * F.pow(n.cast("double"), F.lit(-0.2))
    gap = (hi - lo) / F.lit(float(points - 1))

    def reach(distance: Column) -> Column:
        raw = (F.col("v") + distance - lo) / gap
        return F.greatest(F.least(raw, F.lit(float(points - 1))), F.lit(0.0))

    near = F.sequence(
        F.floor(reach(-39.0 * width)).cast("int"), F.ceil(reach(39.0 * width)).cast("int")
    )
    weighted = ranking.counts(values, "v") if merge_equal else values.withColumn("n", F.lit(1))
    merged = weighted.withColumn("_s", stats)
    visited = merged.filter(width > 0).select("v", "n", "_s", F.explode(near).alias("point"))
    at = lo + F.col("point") * gap
    unit = (at - F.col("v")) / width
    summed = visited.groupBy("point").agg(
        F.sum(F.col("n") * F.exp(unit * unit * F.lit(-0.5))).alias("_sum")
    )
    grid = table.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    height = F.coalesce("_sum", F.lit(0.0)) / (n * width * F.lit(math.sqrt(2 * math.pi)))
    return (
        grid.join(summed, "point", "left")
        .withColumn("_s", stats)
        .filter(width > 0)
        .select(
            F.col("point").cast("bigint").alias("point"),
            at.alias("x"),
            height.alias("density"),
            (height * n * (hi - lo) / F.lit(float(bins))).alias("scaled"),
        )
    )


def top_brands(priced: DataFrame, k: int = 10, brand: str = "Brand") -> DataFrame:
    """Brands with the most products; products without a brand do not count."""
    return ranking.top_counts(priced, brand, k)


def products_of_top_brands(priced: DataFrame, k: int = 5, brand: str = "Brand") -> DataFrame:
    """Products of the ``k`` largest brands. The ``k`` names are broadcast while few."""
    names = top_brands(priced, k, brand).select(brand)
    return priced.join(_if_few(names, k), brand, "left_semi")


def _if_few(per_brand: DataFrame, k: int) -> DataFrame:
    """Broadcast a table of one row for each of ``k`` brands, unless ``k`` is large."""
    return F.broadcast(per_brand) if k <= MAX_BROADCAST_GROUPS else per_brand


def brand_box(
    priced: DataFrame, k: int = 5, brand: str = "Brand", value: str = "Price_Clean"
) -> DataFrame:
    """Box-plot numbers of the ``k`` largest brands.

    Quartiles interpolate linearly. A whisker ends at the last value within 1.5
    interquartile ranges of the box and not inside it.
    """
    merged = _merged_prices(priced, k, brand, value)
    box = _if_few(_quartiles(merged, k, brand, value), k)
    v, low, high = F.col(value), F.col("low_fence"), F.col("high_fence")
    inside = v.between(low, high)
    return (
        merged.join(box, brand)
        .groupBy(brand, "q1", "median", "q3", "rows")
        .agg(
            F.min(F.when(v >= low, v)).alias("_lo"),
            F.max(F.when(v <= high, v)).alias("_hi"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0).cast("bigint")).alias(
                "outliers"
            ),
        )
        .select(
            brand,
            F.col("rows").alias("n"),
            "q1",
            "median",
            "q3",
            F.least("_lo", "q1").alias("whisker_low"),
            F.greatest("_hi", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def brand_outliers(
    priced: DataFrame, k: int = 5, brand: str = "Brand", value: str = "Price_Clean"
) -> DataFrame:
    """Values outside the whiskers with their row counts, for the ``k`` largest brands."""
    merged = _merged_prices(priced, k, brand, value)
    box = _quartiles(merged, k, brand, value).select(brand, "low_fence", "high_fence")
    outside = ~F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return merged.join(_if_few(box, k), brand).filter(outside).select(brand, value, "n")


def _merged_prices(priced: DataFrame, k: int, brand: str, value: str) -> DataFrame:
    chosen = products_of_top_brands(priced, k, brand).filter(F.col(value).isNotNull())
    return ranking.counts(chosen, brand, value)


def _quartiles(merged: DataFrame, k: int, brand: str, value: str) -> DataFrame:
    q = F.col("quantiles")
    reach = (q[2] - q[0]) * 1.5
    quartiles = exact_quantiles(
        merged, brand, value, "n", (0.25, 0.5, 0.75), groups_at_most=k
    )
    return quartiles.select(
        brand,
        "rows",
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        (q[0] - reach).alias("low_fence"),
        (q[2] + reach).alias("high_fence"),
    )


def price_band_share(
    priced: DataFrame, low: float = 5.0, high: float = 20.0, value: str = "Price_Clean"
) -> DataFrame:
    """Products with a price from ``low`` to ``high`` and their share, in one row."""
    inside = F.col(value).between(low, high)
    one_row = priced.agg(
        F.count(value).alias("products"), F.count_if(inside).alias("in_band")
    )
    share = numbers.ratio(F.col("in_band"), F.col("products"))
    return one_row.withColumn("share", share)


def brand_shares(priced: DataFrame, k: int = 10, brand: str = "Brand") -> DataFrame:
    """The ``k`` largest brands with their share of all products that have a brand."""
    counted = ranking.counts(priced.filter(F.col(brand).isNotNull()), brand)
    top = counted.orderBy(F.desc("n"), F.asc(brand)).limit(k)
    return ranking.with_share(top, counted.agg(F.sum("n")))
