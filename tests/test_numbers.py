from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketlens.functions import numbers


def test_rating(values_of):
    texts = ["4.5 out of 5 stars", "", None, "good", "5", "rated 3.", "2023 4.0"]
    assert values_of(numbers.rating_value, texts) == [4.5, None, None, None, 5.0, 3.0, 2023.0]


def test_first_integer(values_of):
    texts = ["12 people found this helpful", "One person", "", None, "1,234 people"]
    assert values_of(numbers.first_integer, texts) == [12, 0, 0, 0, 1]


def test_price(values_of):
    texts = ["$1,299.99", "SGD 12.", "N/A", ",", None, "", "12.50 - 20", "19.99"]
    assert values_of(numbers.price_value, texts) == [
        1299.99, 12.0, None, None, None, None, 12.5, 19.99,
    ]


def test_numeric_or_null(values_of):
    texts = ["1234", "1,234 ratings", " 5 ", "1e3", "12d", "", None, "-.5", "5.", "inf", "x"]
    assert values_of(numbers.numeric_or_null, texts) == [
        1234.0, None, 5.0, 1000.0, None, None, None, -0.5, 5.0, float("inf"), None,
    ]


def test_whole_number(values_of):
    texts = ["3.9", "-3.9", "x", None, "", "nan", "inf", "7"]
    assert values_of(numbers.whole_number_or_null, texts) == [
        3, -3, None, None, None, None, None, 7,
    ]


def test_price_round_trip(values_of):
    rng = random.Random(5)
    prices = [round(rng.uniform(0, 99999), 2) for _ in range(500)]
    assert values_of(numbers.price_value, [f"SGD {p:,.2f}" for p in prices]) == prices


def test_rounding_follows_the_stored_number(spark):
    rng = random.Random(11)
    values = [2.675, 0.125, 0.375, 10.35, 22.65, 290.25, 96.0, 0.0, -2.675, -0.125, 1e300, 2.5]
    values += [rng.randint(0, 40000) / rng.choice([2, 4, 8, 16, 20, 40, 80, 125, 200, 400])
               for _ in range(3000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    table = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for digits in (0, 1, 2, 4):
        rows = table.select("i", numbers.round_half_even(F.col("v"), digits).alias("r")).collect()
        for row in rows:
            assert row.r == round(values[row.i], digits), (values[row.i], digits)


def test_ratio(spark):
    table = spark.createDataFrame([(1, 4), (1, 0), (None, 2)], "a int, b int")
    got = [r[0] for r in table.select(numbers.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.25, 0.0, 0.0]


def test_too_large_an_integer_is_null(values_of):
    assert values_of(numbers.first_integer, ["12345678901234567890 people", "none", "7"]) == [None, 0, 7]
