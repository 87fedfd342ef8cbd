from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import products
from marketlens.operators.quantiles import exact_quantiles
from marketlens.plans.product_report import product_report
from marketlens.sources import readers

SCHEMA = "Title string, Price string, Rating string, Reviews string, Brand string"
ROWS = [
    ("iPhone17 case", "$10.00", "4.5", "12", "A"),
    ("IPHONE  17 Pro", "$1,299.99", "4.0", "1,234 ratings", "A"),
    ("iPhone 17", "N/A", "3.0", "5", "B"),
    ("iPhone 17 clear", ",", "3.0", "5", "B"),
    ("iPhone 16", "$5", "3.0", "5", "C"),
    (None, "$5", "3.0", "5", "C"),
]


def prices(spark, values, brand="A"):
    rows = [(brand, None if v is None else float(v)) for v in values]
    return spark.createDataFrame(rows, "Brand string, Price_Clean double")


def test_filter_and_counts(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    priced = products.priced_products(table).orderBy("Price_Clean").collect()
    assert [(r.Title, r.Price_Clean, r.Title_Lower) for r in priced] == [
        ("iPhone17 case", 10.0, "iphone17 case"), ("IPHONE  17 Pro", 1299.99, "iphone  17 pro"),
    ]
    assert tuple(products.product_counts(table).first()) == (4, 2, 2)


def test_numeric_prices_and_hard_blanks(spark):
    table = spark.createDataFrame(
        [("iPhone\u00a017", 1.5e7, "", "", "A"), ("iphone 17", float("nan"), "", "", "A")],
        SCHEMA.replace("Price string", "Price double"),
    )
    assert tuple(products.product_counts(table).first()) == (2, 1, 1)
    assert products.priced_products(table).first().Price_Clean == 1.5e7


def test_scatter(spark):
    priced = products.priced_products(spark.createDataFrame(ROWS, SCHEMA))
    strict = {tuple(r) for r in products.rating_scatter(priced).collect()}
    assert strict == {(12.0, "4.5", 10.0), (None, "4.0", 1299.99)}
    loose = {tuple(r) for r in products.rating_scatter(priced, strict=False).collect()}
    assert loose == {(12.0, 4.5, 10.0), (1234.0, 4.0, 1299.99)}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bins", [10, 7])
def test_histogram_matches_numpy(spark, seed, bins):
    rng = np.random.default_rng(seed)
    # Values on and next to bin edges are where a quotient alone would err.
    edges = np.linspace(0.1, 7.3, bins + 1)
    values = np.concatenate(
        [rng.choice(np.round(rng.uniform(0.1, 7.3, 50), 1), 300), edges,
         np.nextafter(edges[1:-1], 0), np.nextafter(edges[1:-1], 9)]
    )
    count, left = np.histogram(values, bins=bins)
    table = prices(spark, [*values.tolist(), None, float("nan")])
    got = products.price_histogram(table, bins=bins).orderBy("bin").collect()
    assert [r.n for r in got] == count.tolist()
    assert [r.left_edge for r in got] == left[:-1].tolist()
    assert [r.right_edge for r in got] == left[1:].tolist()


def test_histogram_edge_cases(spark):
    equal = products.price_histogram(prices(spark, [5, 5, 5])).orderBy("bin").collect()
    assert [r.n for r in equal] == np.histogram([5, 5, 5], bins=10)[0].tolist()
    assert products.price_histogram(prices(spark, [])).count() == 0
    assert products.price_histogram(prices(spark, [None])).count() == 0


def test_density_matches_direct_sum(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.round(rng.lognormal(2, 1, 400), 2), [900.0, 900.0]])
    got = products.price_density(prices(spark, values.tolist())).orderBy("point").collect()
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    direct = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(axis=1)
    direct /= len(values) * width * math.sqrt(2 * math.pi)
    assert np.allclose([r.x for r in got], grid)
    assert np.allclose([r.density for r in got], direct, rtol=1e-9, atol=1e-300)
    unit = len(values) * (values.max() - values.min()) / 10
    assert np.allclose([r.scaled for r in got], direct * unit, rtol=1e-9, atol=1e-300)


def test_density_without_spread(spark):
    assert products.price_density(prices(spark, [5, 5])).count() == 0
    assert products.price_density(prices(spark, [5])).count() == 0
    assert products.price_density(prices(spark, [])).count() == 0


@pytest.mark.parametrize("groups_at_most", [None, 10])
def test_quantiles_match_numpy(spark, groups_at_most):
    rng = np.random.default_rng(4)
    groups = {
        "one": [3.0],
        "two": [1.0, 2.0],
        "equal": [7.0] * 50,
        # One value holds most of the rows.
        "hot": [1.0] * 900 + rng.uniform(0, 100, 100).tolist(),
        "wide": (10.0 ** rng.uniform(-5, 9, 3000)).tolist(),
        "negative": rng.normal(0, 5, 777).round(1).tolist(),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    merged = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = exact_quantiles(merged, "g", "v", "n", wanted, groups_at_most=groups_at_most).collect()
    assert {r.g for r in got} == set(groups)
    for row in got:
        assert row.rows == len(groups[row.g])
        assert np.allclose(row.quantiles, np.quantile(groups[row.g], wanted), rtol=1e-12)


def test_box_matches_definition(spark):
    rng = np.random.default_rng(9)
    brands = {b: rng.lognormal(3, 0.7, n).round(2) for b, n in
              [("a", 90), ("b", 80), ("c", 70), ("d", 60), ("e", 50), ("f", 10)]}
    brands["g"] = np.array([1.0, 2.0, 2.0, 2.0, 500.0] * 11)
    rows = [(b, float(v)) for b, values in brands.items() for v in values]
    rows += [(None, 1.0)] * 200 + [("a", None)] * 5
    table = spark.createDataFrame(rows, "Brand string, Price_Clean double")
    got = {r.Brand: r for r in products.brand_box(table).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "g"]
    outliers = products.brand_outliers(table).collect()
    for brand, row in got.items():
        values = brands[brand]
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (row.n, row.q1, row.median, row.q3) == pytest.approx((len(values), q1, median, q3))
        assert row.whisker_low == pytest.approx(min(values[values >= low].min(), q1))
        assert row.whisker_high == pytest.approx(max(values[values <= high].max(), q3))
        outside = values[(values < low) | (values > high)]
        assert row.outliers == len(outside)
        listed = sorted(v for r in outliers if r.Brand == brand for v in [r.Price_Clean] * r.n)
        assert listed == sorted(outside.tolist())


def test_brands(spark):
    rows = [(b, 1.0) for b in "aaabbbccd"] + [(None, 1.0)] * 9
    table = spark.createDataFrame(rows, "Brand string, Price_Clean double")
    assert [tuple(r) for r in products.top_brands(table, 3).collect()] == [
        ("a", 3), ("b", 3), ("c", 2),
    ]
    shares = products.brand_shares(table, 2).orderBy("Brand").collect()
    assert [(r.Brand, r.n, r.share) for r in shares] == [("a", 3, 3 / 9), ("b", 3, 3 / 9)]
    assert products.products_of_top_brands(table, 2).count() == 6


def test_band_share(spark):
    row = products.price_band_share(prices(spark, [4.99, 5, 20, 20.01, None])).first()
    assert tuple(row) == (4, 2, 0.5)
    assert tuple(products.price_band_share(prices(spark, [])).first()) == (0, 0, 0.0)


def test_required_columns(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    assert readers.require_columns(table) is table
    with pytest.raises(ValueError, match="Brand"):
        readers.require_columns(table.drop("Brand"))


def test_product_report(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    report = product_report(table, str(tmp_path))
    assert tuple(report["counts"].first()) == (4, 2, 2)
    assert sum(r.n for r in report["histogram"].collect()) == 2
    assert report["density"].count() == 200
    assert report["brand_box"].count() == 1
    stored = spark.read.parquet(f"{tmp_path}/products_priced")
    assert stored.columns == [*table.columns, "Price_Clean", "Title_Lower"]
    assert stored.count() == 2


def test_values_that_are_not_finite_do_not_count(spark):
    table = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,)], "Price_Clean double")
    assert sum(r.n for r in products.price_histogram(table).collect()) == 2
    merged = {r.point: r.density for r in products.price_density(table).collect()}
    straight = {r.point: r.density for r in products.price_density(table, merge_equal=False).collect()}
    assert len(merged) == 200 and all(abs(merged[p] - straight[p]) < 1e-12 for p in merged)
