"""What the item queries may cost: pages dealt over the tasks, start tags looked for once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from entry_queries import roles
from marketlens.functions import markup
from marketlens.operators import pages


@pytest.mark.parametrize("role", [roles.item_pages, roles.ranking_pages])
def test_pages_of_one_small_file_are_dealt(spark, tmp_path, role):
    """A thousand parts are one split of some kilobytes and a megabyte of pages."""
    spark.range(1000).select(
        F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"),
        F.lit("name").alias("p_name"), F.lit("brand").alias("p_brand"), F.lit(9.5).alias("p_retailprice"),
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = role(spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).groupBy("task").count()
    counts = [r["count"] for r in rows.collect()]
    assert len(counts) >= 8 and max(counts) < 250 and sum(counts) == 1000


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_start_tag_is_looked_for_once(spark):
    trees = spark.createDataFrame([("<b id='t'>x</b>",)], "html string").select(
        F.explode(F.array(markup.parsed(F.col("html")))).alias("tree")
    )
    tag = markup.open_tag("b", "t")
    assert plan_of(trees.select(markup.element_tokens(F.col("tree"), tag).alias("r"))).count("^<(?i:b)") == 1
    rule = pages.FieldRule((tag,), skip_empty=True)
    assert plan_of(trees.select(pages.field_text(F.col("tree"), rule).alias("r"))).count("^<(?i:b)") == 1


def test_ends_of_many_shapes(value_of):
    """Deep, crossed, unclosed, void and stray tags, and one element in a thousand."""
    shapes = {
        "<a><b><c id=k>1</a>2</c>": "1",
        "<b id=k>1<i>2</b>3</i>4": "12",
        "<p id=k>1<br/>2<hr>3</P>4": "123",
        "</b></i><b id=k>1</b>2": "1",
        "<u><u id=k>1<u>2</u>3</u>4</u>5": "123",
        "<i>" * 300 + "<b id=k>1</b>2" + "</i>" * 300: "1",
        "<i>0</i>" * 1000 + "<b id=k>1<i>2</i>": "12",
    }
    rule = markup.open_tag(element_id="k")
    for page, want in shapes.items():
        assert value_of(lambda c: markup.tokens_text(markup.element_tokens(markup.parsed(c), rule)), page) == want
