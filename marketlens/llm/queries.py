"""One query for each numbered operator, over the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import (
    decontaminate,
    html_text,
    jaccard,
    lexical_search,
    licenses,
    nearest,
    packing,
    resample,
    sharding,
    tandem_runs,
    token_counts,
    toxicity,
    url_rules,
)
from marketlens.llm.tables import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[build.__name__] = build
    return build


#: Host, path and verdict of the url rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op1_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)


@query
def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op5_decontamination(spark, sf_dir):
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(hits)


@query
def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


@query
def op7_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return resample.score_quality(documents, resample.fit(documents, table(spark, sf_dir, "labels")))


@query
def op4_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_html_extraction(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op6_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@query
def op8_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op13_lexical_search(spark, sf_dir):
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_periodic_runs(spark, sf_dir):
    return tandem_runs.periodic_runs(table(spark, sf_dir, "documents"))
