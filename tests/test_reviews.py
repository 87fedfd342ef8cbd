from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.operators import reviews, summary
from marketlens.plans import review_report
from marketlens.sources import writers

SCHEMA = ", ".join(f"{c} string" for c in fv.REVIEW_COLUMNS)
RAW = [
    ("A1", "1", "1", "Great case", "5.0 out of 5 stars", "d1", "Itâ€™s sturdy, grip is sturdy", "12 people", "yes"),
    ("A1", "2", "1", None, "4.0 out of 5 stars", "d2", "Sturdy   grip\nand camera lens", "", "YES"),
    ("A2", "3", "2", "Bad", "2.0 out of 5 stars", "d3", "Magnet fell off, magnet weak", None, "no"),
    ("A2", "4", "2", "So so", "3.0 out of 5 stars", "d4", "Average item", "x", "yes"),
    (None, "5", "2", "?", "no stars", "d5", "Unrated item", "1", "yes"),
    ("A3", "6", "1", "Empty", "5.0", "d6", "  \n ", "", "yes"),
    ("A3", "7", "1", "Pâté", "5.0", "d7", "tasty", "", "yes"),
    ("A3", "8", "1", "Привет", "5.0", "d8", "да", "", "yes"),
    ("A3", "9", "1", "Number", "5.0", "d9", None, "", "yes"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, SCHEMA)


@pytest.fixture(scope="module")
def cleaned(raw):
    return reviews.clean_reviews(raw)


@pytest.fixture(scope="module")
def enriched(cleaned):
    return reviews.enrich_reviews(cleaned)


def rows(table):
    return [tuple(r) for r in table.collect()]


def test_drop_reasons(raw):
    tagged = reviews.tag_reviews(raw)
    assert rows(reviews.drop_counts(tagged)) == [(2, 2, 5)]
    reasons = {r.review_id: r.drop_reason for r in tagged.collect()}
    assert reasons["6"] == reasons["9"] == fv.EMPTY_REVIEW
    assert reasons["7"] == reasons["8"] == fv.UNREADABLE_REVIEW


def test_cleaned_columns(cleaned):
    assert tuple(cleaned.columns) == fv.CLEAN_REVIEW_COLUMNS
    got = {r.review_id: r for r in cleaned.collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5"]
    first = got["1"]
    assert first.review_text == "It's sturdy, grip is sturdy"
    assert (first.review_char_length, first.review_word_count) == (27, 3)
    assert (first.helpful_count, first.review_rating_value) == (12, 5.0)
    assert got["2"].review_title == "" and got["2"].helpful_count == 0
    assert got["5"].ASIN == "" and got["5"].review_rating_value is None


def test_missing_columns_read_as_empty(spark):
    table = spark.createDataFrame([("fine text",)], "review_text string")
    row = reviews.clean_reviews(table).first()
    assert (row.ASIN, row.review_title, row.helpful_count, row.review_rating_value) == (
        "", "", 0, None,
    )


def test_unique_ids(raw):
    doubled = raw.unionAll(raw)
    assert reviews.clean_reviews(doubled).count() == 10
    assert reviews.clean_reviews(doubled, unique_ids=True).count() == 5


def test_options(raw):
    lenient = reviews.clean_reviews(raw, threshold=0.0, garbled_markers="Ø")
    assert {r.review_id for r in lenient.collect()} == {"1", "2", "3", "4", "5", "7", "8"}


def test_polarity(spark):
    table = spark.createDataFrame([(4.0,), (3.9,), (2.0,), (2.1,), (None,)], "r double")
    got = [r[0] for r in table.select(reviews.polarity(F.col("r"))).collect()]
    assert got == ["positive", None, "negative", None, None]


def test_top_terms(enriched):
    assert rows(reviews.top_words(enriched, "positive", 2)) == [("sturdy", 3), ("grip", 2)]
    assert rows(reviews.top_words(enriched, "negative", 3)) == [
        ("magnet", 2), ("fell", 1), ("off", 1),
    ]
    assert rows(reviews.top_ngrams(enriched, "positive", 1)) == [("sturdy grip", 2)]


def test_themes(enriched):
    assert rows(reviews.theme_counts(enriched)) == [
        ("fit_and_grip", 2), ("camera_screen", 1), ("magnet_strength", 1),
    ]
    assert set(rows(reviews.theme_polarity(enriched))) == {
        ("fit_and_grip", 2, 0, 0), ("camera_screen", 1, 0, 0), ("magnet_strength", 0, 1, 0),
    }


def test_stats(cleaned):
    row = reviews.review_stats(cleaned).first()
    assert (row.total_reviews, row.unique_asins, row.avg_reviews_per_asin) == (5, 3, 1.67)
    assert row.verified_purchase_rate == 0.8
    assert rows(reviews.rating_distribution(cleaned)) == [(2.0, 1), (3.0, 1), (4.0, 1), (5.0, 1)]
    assert rows(reviews.length_by_rating(cleaned))[0] == (2.0, 28.0, 1)


def test_stats_of_nothing(cleaned):
    none = cleaned.limit(0)
    assert tuple(reviews.review_stats(none).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


STATUS = [
    ("Yes ", "ok>captcha", "3.9"), ("no", "ok", "x"), (" yes", "ok", None), (None, None, "nan"),
    ("no", "ok", "7"), ("no", "", "inf"),
]


@pytest.fixture(scope="module")
def status(spark):
    return spark.createDataFrame(STATUS, ", ".join(f"{c} string" for c in fv.STATUS_COLUMNS))


def test_crawl(status):
    assert reviews.crawl_coverage(status).first().asDict() == {
        "total_asins_attempted": 6, "captcha_rows": 2, "review_count_sum": 10,
        "captcha_rate": 0.3333,
    }
    assert rows(reviews.top_status_traces(status, 2)) == [("ok", 3), ("", 2)]


def test_crawl_rate_of_the_sample(spark):
    table = spark.range(30).select(F.when(F.col("id") < 17, "yes").alias("is_captcha"))
    row = reviews.crawl_coverage(table).first()
    assert (row.captcha_rate, row.review_count_sum) == (0.5667, 0)


def test_term_lists(enriched):
    lists = summary.term_lists(enriched, 2, 1).first()
    assert [tuple(t) for t in lists.positive_top_words] == [("sturdy", 3), ("grip", 2)]
    assert [tuple(t) for t in lists.positive_top_bigrams] == [("sturdy grip", 2)]
    assert [tuple(t) for t in lists.negative_top_words] == [("magnet", 2), ("fell", 1)]


def test_report(spark, raw, status, tmp_path):
    out = str(tmp_path / "out")
    record = review_report.review_report(raw, status, out).first()
    assert record.review_stats.total_reviews == 5
    assert record.rating_distribution == {"2.0": 1, "3.0": 1, "4.0": 1, "5.0": 1}
    assert record.painpoint_counts["fit_and_grip"] == 2
    assert record.cleaning_filters.asDict() == {fv.EMPTY_REVIEW: 2, fv.UNREADABLE_REVIEW: 2}
    assert record.crawl_status.status_trace_top["ok"] == 3
    assert record.headline.positive_words[0] == "sturdy"
    assert record.headline.themes == ["fit_and_grip", "camera_screen", "magnet_strength"]
    assert spark.read.parquet(f"{out}/reviews_cleaned").count() == 5
    text = "\n".join(r.value for r in spark.read.text(f"{out}/review_summary").collect())
    document = json.loads(text)
    assert document["review_stats"]["unique_asins"] == 3
    assert list(document["rating_distribution"]) == ["2.0", "3.0", "4.0", "5.0"]
    assert list(document["painpoint_counts"].items())[0] == ("fit_and_grip", 2)
    assert list(document["crawl_status"]["status_trace_top"])[0] == "ok"


def test_report_without_reviews(spark, raw, status, tmp_path):
    out = str(tmp_path / "out")
    record = review_report.review_report(raw.limit(0), status, out).first()
    assert record.review_stats.total_reviews == 0
    assert record.positive_top_words == [] and record.rating_distribution == {}
    assert not os.path.exists(f"{out}/reviews_cleaned")


def test_csv_sink_keeps_text(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([("é \"q\", x", None), ("", "y")], "a string, b string")
    assert writers.write_table(table, path, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {tuple(r) for r in back.collect()} == {('é "q", x', None), (None, "y")}
    with pytest.raises(ValueError):
        writers.write_table(table, path, "xml")


def test_unique_ids_are_repeatable(spark):
    rows = [("r1", "b", "5.0"), ("r1", "a", "1.0"), ("r2", "c", "3.0")]
    names = "review_id string, review_text string, review_rating_text string"
    for order in (rows, rows[::-1]):
        raw = spark.createDataFrame(order, names).repartition(2)
        got = {r.review_id: r.review_text for r in reviews.clean_reviews(raw, threshold=0.0, unique_ids=True).collect()}
        assert got == {"r1": "a", "r2": "c"}
