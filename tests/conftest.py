from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from marketlens.session import build_session

    session = build_session(
        "marketlens-tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value_of(spark):
    """Value of a Column function for one text."""
    from pyspark.sql import functions as F

    def evaluate(function, text):
        table = spark.createDataFrame([(text,)], "x string")
        return table.select(function(F.col("x")).alias("y")).first()[0]

    return evaluate


@pytest.fixture(scope="session")
def values_of(spark):
    """Values of a Column function for many texts, in order."""
    from pyspark.sql import functions as F

    def evaluate(function, texts):
        table = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
        rows = table.select("i", function(F.col("x")).alias("y")).collect()
        return [row.y for row in sorted(rows, key=lambda r: r.i)]

    return evaluate
