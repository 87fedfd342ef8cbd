from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.operators import reviews
from marketlens.sources import readers, writers


def test_review_csv(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "﻿ASIN,review_id,review_text,review_rating_text\n"
        'B0,1,"two\nlines, ""quoted""",5.0 out of 5 stars\n'
        "B0,2,  kept  blanks ,\n",
        encoding="utf-8",
    )
    table = readers.read_reviews(spark, str(path))
    assert table.columns == ["ASIN", "review_id", "review_text", "review_rating_text"]
    assert set(t for _, t in table.dtypes) == {"string"}
    rows = table.orderBy("review_id").collect()
    assert rows[0].review_text == 'two\nlines, "quoted"'
    assert rows[1].review_text == "  kept  blanks "
    cleaned = reviews.clean_reviews(table).orderBy("review_id").collect()
    assert cleaned[0].review_text == 'two lines, "quoted"'
    assert cleaned[1].review_text == "kept blanks"


def test_product_csv(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("Title,Price,Rating,Reviews,Brand,n\na,N/A,4,5,NA,1\nb,$1,,x,B,2\n")
    rows = readers.read_products(spark, str(path)).orderBy("n").collect()
    assert (rows[0].Price, rows[0].Brand, rows[1].Rating) == (None, None, None)
    bad = tmp_path / "bad.csv"
    bad.write_text("Title,Price\na,1\n")
    with pytest.raises(ValueError):
        readers.read_products(spark, str(bad))


def test_crawl_log_and_pages(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("is_captcha,status_trace,review_count\nyes,a,3\n")
    assert readers.read_crawl_log(spark, str(log)).count() == 1
    folder = str(tmp_path / "pages")
    spark.createDataFrame([("u", "<p>")], "url string, html string").write.parquet(folder)
    assert readers.read_pages(spark, folder).count() == 1
    other = str(tmp_path / "other")
    spark.range(1).write.parquet(other)
    with pytest.raises(ValueError):
        readers.read_pages(spark, other)


def test_empty_table_writes_nothing(spark, tmp_path):
    path = tmp_path / "t"
    assert not writers.write_table(spark.range(0), str(path))
    assert not path.exists()
    assert writers.write_table(spark.range(1), str(path))


def test_spread_only_where_it_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    few = spark.read.parquet(path)
    assert readers.spread(few) is few
    assert readers.spread(few, 5).rdd.getNumPartitions() == 5


def test_format_of_a_folder_of_csv_parts(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.createDataFrame([("a", "b")], "x string, y string").write.option("header", True).csv(path)
    assert [tuple(r) for r in readers.read_table(spark, path, "csv").collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        readers.read_table(spark, path, "orc")


def test_staged_table_starts_from_files(spark, tmp_path):
    table = spark.range(10).withColumn("x", F.col("id") * 2)
    stored = writers.staged(table, str(tmp_path))
    assert stored.schema.names == ["id", "x"] and stored.count() == 10
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()


class _Session:
    """As much of a session as the folder choice looks at."""

    def __init__(self, setting, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_clusters():
    assert writers.shared_folder(_Session("/shared/folder/", "k8s://x")) == "/shared/folder"
    with pytest.raises(ValueError):
        writers.shared_folder(_Session(None, "k8s://x"))
    local = _Session(None, "local[2]")
    assert writers.shared_folder(local) == writers.shared_folder(local)
