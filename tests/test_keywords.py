from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens.operators import keywords
from marketlens.sources import readers

# The two listings and the published coverage of eight keywords.
BEFORE = "iPhone 16 Pro Phone Case Clear Protective Cover"
AFTER = (
    "iPhone 16 Pro Case, Magnetic Clear Case for MagSafe, Shockproof Slim Phone Cover with "
    "Anti-Yellowing Back, Raised Camera Protection, Scratch Resistant Transparent Case for "
    "iPhone 16 Pro 6.3 Inch"
)
BULLETS_AFTER = [
    "Strong Magnetic for MagSafe Built-in magnetic ring aligns securely with MagSafe chargers, "
    "wallets and car mounts for stable daily use.",
    "Clear Back with Anti-Yellowing Design Transparent hard back shows the original color of "
    "your iPhone 16 Pro while anti-yellowing material helps keep the case looking clean over time.",
    "Shockproof Daily Protection Flexible bumper and reinforced corners help absorb daily drops "
    "and bumps, while raised edges protect the screen and camera.",
    "Slim Fit and Comfortable Grip Lightweight profile keeps your phone easy to hold and "
    "pocket-friendly without adding bulky weight.",
    "Precise Cutouts and Scratch Resistance Responsive buttons, accurate cutouts and a durable "
    "back panel support smooth daily use and better long-term durability.",
]
COVERAGE = {
    "iphone 16 pro case": ("Yes", "Yes", "Title"),
    "magsafe case": ("No", "Yes", "Title + Bullet 1"),
    "clear case": ("Partial", "Yes", "Title + Bullet 2"),
    "shockproof case": ("No", "Yes", "Title + Bullet 3"),
    "anti-yellowing case": ("No", "Yes", "Title + Bullet 2"),
    "slim case": ("No", "Yes", "Title + Bullet 4"),
    "camera protection": ("No", "Yes", "Title + Bullet 3"),
    "scratch resistant": ("No", "Yes", "Title + Bullet 5"),
}

# Keyword, priority and recommended placement of the curated table.
CURATED = """
iphone 16 pro case|High|Title; Bullet; Search Terms
iphone 16 pro max case|Medium|Search Terms
iphone case|Low|Search Terms
iphone 15 pro case|Medium|Search Terms
magsafe case|High|Title; Bullet 1; Search Terms
iphone 16 pro magsafe case|High|Title; Bullet 1
magnetic phone case|Medium|Bullet 1; Search Terms
clear phone case|High|Title; Bullet 2
clear magsafe case|High|Bullet 2; Search Terms
shockproof phone case|High|Bullet 3; Search Terms
drop protection case|Medium|Bullet 3; A+ Page
anti yellowing case|High|Bullet 2; A+ Page; Search Terms
slim phone case|Medium|Bullet 4; Search Terms
thin protective case|Medium|Bullet 4
camera protection case|Medium|Bullet 3; A+ Page
raised edge phone case|Medium|Bullet 3; Search Terms
scratch resistant case|Medium|Bullet 5; Search Terms
anti fingerprint case|Medium|Bullet 5
matte phone case|Low|Search Terms
silicone phone case|Low|Search Terms
phone case with screen protector|Medium|Title; Bullet
phone case with camera protector|Medium|Bullet; Search Terms
case for daily use|Low|Description; A+ Page
business phone case|Low|Description
gift for iphone users|Low|A+ Page
wireless charging case|Medium|Bullet 1; Search Terms
car mount compatible case|Medium|Bullet 1; A+ Page
bulky case|Observation|N/A
yellowing clear case|Observation|N/A
weak magnet case|Observation|N/A
"""


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(
        [("before", BEFORE, ["Designed for iPhone 16 Pro"]), ("after", AFTER, BULLETS_AFTER)],
        "listing_id string, title string, bullets array<string>",
    )


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    """The table as a CSV file with quoted line breaks and a blank last row."""
    path = tmp_path_factory.mktemp("kw") / "keywords.csv"
    lines = ["Keyword,Category,Intent,Priority,Recommended Placement,Notes"]
    for line in CURATED.strip().splitlines():
        word, priority, placement = line.split("|")
        lines.append(f'{word},kind,"an ""intent""",{priority},{placement},"two\nlines, é"')
    path.write_text("﻿" + "\n".join(lines) + "\n,,,,,\n", encoding="utf-8")
    return readers.read_keywords(spark, str(path))


def test_published_coverage(listings):
    cells = {
        (r.listing_id, r.keyword): r.coverage
        for r in keywords.keyword_coverage(listings, list(COVERAGE)).collect()
    }
    assert len(cells) == 16
    for keyword, (before, after, _) in COVERAGE.items():
        assert (cells["before", keyword], cells["after", keyword]) == (before, after)


def test_published_placement(listings):
    placed = keywords.keyword_placement(listings, list(COVERAGE)).filter(
        F.col("listing_id") == "after"
    )
    got = {r.keyword: r.placement for r in placed.collect()}
    agreeing = [k for k, (_, _, where) in COVERAGE.items() if got[k] == where]
    # The first keyword also stands in the second bullet; the table was set by hand.
    assert len(agreeing) == 7
    assert got["iphone 16 pro case"] == "Title + Bullet 2"


def test_coverage_totals(listings):
    got = {tuple(r) for r in keywords.coverage_totals(listings, ["clear case"]).collect()}
    assert got == {("clear case", "Partial", 1), ("clear case", "Yes", 1)}


def test_coverage_edges(spark):
    table = spark.createDataFrame([(None,), ("cased",), ("Slim-case",)], "title string")
    got = [
        r.coverage for r in keywords.keyword_coverage(table, ["case"], keep=()).collect()
    ]
    assert got == ["No", "No", "Yes"]
    assert [r[1] for r in keywords.keyword_coverage(table, ["--"], keep=()).collect()] == ["No"] * 3
    with pytest.raises(ValueError):
        keywords.keyword_coverage(table, [])


def test_long_keyword_list(spark):
    table = spark.createDataFrame([("word7 word450",), ("none",)], "title string")
    words = [f"word{i}" for i in range(451)]
    rows = keywords.keyword_coverage(table, words, keep=("title",)).collect()
    assert len(rows) == 902
    assert {r.keyword for r in rows if r.coverage == "Yes"} == {"word7", "word450"}


def test_curated_table(curated):
    assert curated.count() == 30
    row = curated.first()
    assert row.Notes == "two\nlines, é" and row.Intent == 'an "intent"'


def test_placement_counts(curated):
    got = {r.placement: r.n for r in keywords.placement_counts(curated).collect()}
    assert got == {
        "Search Terms": 16, "A+ Page": 6, "Title": 5, "Bullet 1": 5, "Bullet 3": 4, "Bullet": 3,
        "Bullet 2": 3, "N/A": 3, "Bullet 4": 2, "Bullet 5": 2, "Description": 2,
    }


def test_tier_counts(curated):
    got = {r.Priority: r.n for r in keywords.tier_counts(curated, "Priority").collect()}
    assert got == {"Medium": 14, "High": 7, "Low": 6, "Observation": 3}
    assert keywords.tier_counts(curated).columns == ["Category", "Priority", "n"]


def test_bounded_list(curated):
    assert len(readers.bounded_list(curated, "Keyword")) == 30
    with pytest.raises(ValueError):
        readers.bounded_list(curated, "Keyword", 29)


def test_hits_are_the_covered_cells(spark, listings):
    table = spark.createDataFrame([(k,) for k in COVERAGE], "keyword string")
    cells = {(r.listing_id, r.keyword): r.coverage for r in keywords.keyword_coverage(listings, list(COVERAGE)).collect()}
    hits = {(r.listing_id, r.keyword): r.coverage for r in keywords.keyword_hits(listings, table).collect()}
    assert hits == {k: v for k, v in cells.items() if v != "No"}


def test_a_long_title_without_the_last_word(spark):
    import time

    title = " ".join(["of", "the", "and", "to", "x"] * 1000)
    table = spark.createDataFrame([(title,)], "title string")
    start = time.perf_counter()
    assert keywords.keyword_coverage(table, ["of the and to zebra"], keep=()).first().coverage == "No"
    assert keywords.keyword_hits(table, ["of the and to zebra"], keep=()).count() == 0
    assert keywords.keyword_hits(table, ["x to of"], keep=()).first().coverage == "Yes"
    assert time.perf_counter() - start < 10
