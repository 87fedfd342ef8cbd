"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from entry_queries import roles
from entry_queries.queries import REGISTRY
from marketlens.operators import products, reviews, summary

SF_DIR = "/root/testdata/sf0.001"


def plan_of(table, executed=False):
    if executed:
        table.collect()
    text = table._jdf.queryExecution().executedPlan().toString()
    # After a run only the plan that ran counts.
    return text.split("== Initial Plan ==")[0] if executed else text


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"review_summary", "summary_json"}))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(REGISTRY[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert bad not in plan


def test_narrow_queries_do_not_shuffle(spark):
    for name in ("product_filter", "scatter_points", "price_parse", "numeric_coerce"):
        assert "Exchange" not in plan_of(REGISTRY[name](spark, SF_DIR))


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(REGISTRY["price_histogram"](spark, SF_DIR))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"l_extendedprice:double"}
    plan = plan_of(REGISTRY["brand_top10"](spark, SF_DIR))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"p_brand:string"}


def test_top_lists_keep_k_rows_per_task(spark):
    for name in ("top_words_positive", "brand_top10", "status_top5"):
        assert "TakeOrderedAndProject" in plan_of(REGISTRY[name](spark, SF_DIR))
    cleaned = reviews.clean_reviews(roles.raw_reviews(spark, SF_DIR))
    lists = plan_of(summary.term_lists(reviews.enrich_reviews(cleaned)))
    before_shuffle = re.search(r"WindowGroupLimit .*Partial", lists)
    assert before_shuffle, "rank filter must act before rows of a list meet"


def test_repair_runs_once_per_row(spark):
    cleaned = reviews.clean_reviews(roles.raw_reviews(spark, SF_DIR))
    words = reviews.top_words(reviews.enrich_reviews(cleaned), "positive")
    plan = plan_of(words)
    # One for the title, one for the text; repeats would mean a repeated repair.
    assert plan.count("try_validate_utf8") <= 4


def test_box_scans_once_and_never_shuffles_by_brand(spark):
    table = products.brand_box(roles.priced_lines(spark, SF_DIR))
    plan = plan_of(table, executed=True)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    # One scan finds the top brands and one merges their prices.
    assert len(scans) == 2
    assert "SortMergeJoin" not in plan


def test_density_and_histogram_share_their_one_row(spark):
    plan = plan_of(REGISTRY["price_density"](spark, SF_DIR), executed=True)
    assert "ReusedSubquery" in plan
