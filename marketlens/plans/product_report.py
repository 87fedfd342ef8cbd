"""Products to the filtered table and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens import fixed_values as fv
from marketlens.operators import products
from marketlens.sources import readers, writers


def product_report(
    table: DataFrame, out_dir: str, pattern: str = fv.MODEL_PATTERN, file_format: str = "parquet"
) -> dict[str, DataFrame]:
    """Write the priced products of a model; return counts and chart data by name.

    The chart data start from the written table, not from the source.
    """
    checked = readers.missing_to_null(readers.require_columns(table))
    path = f"{out_dir}/products_priced"
    priced = products.priced_products(checked, pattern)
    if file_format == "parquet":  # the target itself is what the charts read
        priced.write.mode("overwrite").parquet(path)
        stored = priced.sparkSession.read.schema(priced.schema).parquet(path)
    else:
        stored = writers.staged(priced, f"{out_dir}/work")
        writers.write_table(stored, path, file_format)
    return {
        "counts": products.product_counts(checked, pattern),
        "histogram": products.price_histogram(stored),
        "density": products.price_density(stored),
        "scatter": products.rating_scatter(stored),
        "top_brands": products.top_brands(stored),
        "brand_box": products.brand_box(stored),
        "brand_outliers": products.brand_outliers(stored),
        "band_share": products.price_band_share(stored),
        "brand_shares": products.brand_shares(stored),
    }
