"""Sinks: Parquet and CSV tables, ragged detail rows, one JSON document."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(table: DataFrame, path: str, file_format: str = "parquet") -> bool:
    """Write a table; an empty one writes nothing. Says whether it wrote.

    The emptiness test reads only until the first row turns up.
    """
    if table.isEmpty():
        return False
    writer = table.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}")
    return True


def union_ragged(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns, absent cells null."""
    if not tables:
        raise ValueError("at least one table is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_json_text(table: DataFrame, pretty: bool = False) -> DataFrame:
    """Each row as one JSON text in column ``value``; non-ASCII characters stay."""
    options = {"pretty": "true"} if pretty else {}
    return table.select(F.to_json(F.struct("*"), options).alias("value"))


def write_json_document(one_row: DataFrame, path: str, pretty: bool = True) -> None:
    """Write a one-row summary as a text file that holds one JSON document."""
    to_json_text(one_row, pretty).write.mode("overwrite").text(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, for tables in between.

    Without that setting a local session uses its warehouse; nothing goes to a temporary folder
    of one machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None) or "spark-warehouse"
    return f"{warehouse.rstrip('/')}/marketlens-work"


def staged(table: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to Parquet and read it back, so that what follows starts from files.

    Several statistics over one costly table then compute it once, read only the columns
    they need, and survive lost executors without starting over.
    """
    spark = table.sparkSession
    path = f"{folder or shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
