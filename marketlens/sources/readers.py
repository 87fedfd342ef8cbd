"""Sources: review, crawl-log, product, page and keyword tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions.text import WHITESPACE

# Cells that count as missing in product tables.
MISSING_CELLS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_text_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A CSV table with a header, every cell kept as text.

    Quoted cells may hold line breaks and doubled quotes. Such files cannot be split,
    so write large tables as many files or, better, as Parquet (``read_table``).
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("quote", '"')
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_table(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Any of the tables, ``file_format`` being ``csv`` or ``parquet``.

    Without it, a path that ends in a CSV suffix is read as CSV and any other as Parquet; a
    folder of CSV parts under another name needs the format.
    """
    csv = path.rstrip("/").endswith((".csv", ".csv.gz")) if file_format is None else file_format == "csv"
    if file_format not in (None, "csv", "parquet"):
        raise ValueError(f"unknown format {file_format!r}")
    return read_text_table(spark, path) if csv else spark.read.parquet(path)


def spread(table: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt over ``partitions`` tasks, or the table as it is.

    A CSV file with line breaks in cells or a file of one row group is read by one task, which
    then does all of the text work too; whoever reads such a file says how many tasks should.
    """
    return table if partitions is None else table.repartition(partitions)


def read_reviews(
    spark: SparkSession, path: str, partitions: int | None = None, file_format: str | None = None
) -> DataFrame:
    """Raw reviews; see ``REVIEW_COLUMNS`` for the columns that are used."""
    return spread(read_table(spark, path, file_format), partitions)


def read_crawl_log(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Crawl status rows; see ``STATUS_COLUMNS`` for the columns that are used."""
    return read_table(spark, path, file_format)


def require_columns(
    products: DataFrame, required: Sequence[str] = fv.REQUIRED_PRODUCT_COLUMNS
) -> DataFrame:
    """The table itself, or ``ValueError`` if a required column is absent."""
    missing = [name for name in required if name not in products.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; required: {list(required)}")
    return products


def missing_to_null(table: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become null."""
    text_columns = {f.name for f in table.schema.fields if f.dataType.typeName() == "string"}
    return table.select(
        *(
            F.when(~table[c].isin(*MISSING_CELLS), table[c]).alias(c) if c in text_columns else table[c]
            for c in table.columns
        )
    )


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products with the required columns checked and missing cells null."""
    return missing_to_null(require_columns(read_table(spark, path)))


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Stored pages: ``url`` and ``html``, one row each."""
    return spread(require_columns(spark.read.parquet(path), ("url", "html")), partitions)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Curated keywords; rows without a keyword are left out."""
    table = require_columns(read_table(spark, path), fv.KEYWORD_COLUMNS)
    return table.filter(F.btrim(F.col("Keyword"), F.lit(WHITESPACE)) != "")


def bounded_list(table: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """A small column as a Python list; ``ValueError`` if it has over ``limit`` rows.

    For curated configuration such as keywords and lexicons, never for data.
    """
    rows = table.select(column).take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"column {column!r} has more than {limit} rows")
    return [row[0] for row in rows]
