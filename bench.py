"""Headline timings: median of warm runs per query, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "mojibake_repair", "ascii_letter_ratio", "price_parse", "rating_parse", "drop_reasons",
    "clean_reviews", "top_words_positive", "top_bigrams_positive", "theme_counts",
    "theme_polarity", "review_stats", "length_by_rating", "crawl_coverage", "status_top5",
    "review_summary", "product_filter", "price_histogram", "price_density", "value_density",
    "brand_top10", "brand_box_top5", "line_price_box", "price_band_share", "brand_share",
    "value_box", "page_links", "page_ids_fallback", "page_ids_all", "page_fields", "item_details", "item_details_quick", "item_harvest",
    "keyword_coverage", "keyword_hits", "keyword_coverage_totals", "keyword_placement",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from entry_queries.queries import REGISTRY
    from marketlens.session import build_session

    spark = build_session(
        "marketlens-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.marketlens.inputPartitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
