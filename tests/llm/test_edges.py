"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marketlens.llm import (
    decontaminate,
    html_text,
    jaccard,
    labelled,
    licenses,
    nearest,
    packing,
    resample,
    sharding,
    toxicity,
    url_rules,
)
from marketlens.llm.queries import URL_RULES, vocabulary

#: Columns whose names operators use for their own.
CLASHES = (
    "key size crc part shard slot rank law n set_number component shingle head score predicted held_out "
    "license digest notices body known lines copies spans items n_words ids start length bucket sequence_id "
    "label fold log_weight sample_key selected place id vector host path rule verdict sort_key"
).split()


def clashing(frame):
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in frame.columns])


TEXTS = [
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "one two three four five six"),
    (5, "one two three four five six"),
    (5, "one two three four five six"),
    (6, "Ünï çödé 漢字 😀 <|endoftext|> it's \x1f odd\u00a0space"),
    (7, "long " * 200_000),
    (8, "You are an idiot."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(TEXTS, "doc_id long, text string")).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, "two three four"), (2, None), (3, ""), (None, "one two"), (1, "two three four")]
    return clashing(spark.createDataFrame(items, "item_id long, text string"))


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(
        spark.createDataFrame([(1, 1, 0), (8, 0, 1), (2, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    )


def by_id(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row[0], []).append(row)
    return out


def operators(bench, labels):
    return {
        "shard": lambda d: sharding.shard_by_bytes(d, 3),
        "hits": lambda d: decontaminate.contamination(decontaminate.benchmark_hits(d, bench)),
        "jaccard": jaccard.similar_documents,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.learn(d, labels)),
        "quality": lambda d: resample.score_quality(d, resample.fit(d, labels)),
        "packing": lambda d: packing.packed(d, vocabulary()),
        "licenses": lambda d: licenses.license_scan(d, licenses.known_licenses(d.sparkSession)),
    }


@pytest.mark.parametrize("name", ["shard", "hits", "jaccard", "toxicity", "quality", "packing", "licenses"])
def test_document_operators(docs, none, bench, labels, name):
    work = operators(bench, labels)[name]
    found = work(docs)
    assert work(none).columns == found.columns
    assert work(none).count() == 0
    rows = by_id(found)
    assert set(rows) == {i for i, _ in TEXTS}
    if name != "packing":
        assert sum(map(len, rows.values())) == len(TEXTS)
        assert len(rows[5]) == 2


def test_shards(docs):
    rows = by_id(sharding.shard_by_bytes(docs, 3))
    assert rows[2][0].size == 1 and rows[2][0].text_crc32 == 0
    assert rows[3][0].size == 1
    everything = [r for group in rows.values() for r in group]
    for shard in {r.shard for r in everything}:
        slots = sorted(r.slot for r in everything if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard is None for r in everything)


def test_hits(docs, bench):
    rows = by_id(decontaminate.contamination(decontaminate.benchmark_hits(docs, bench)))
    assert (rows[1][0].n_words, rows[1][0].n_hit, rows[1][0].n_items) == (6, 3, 1)
    for i in (2, 3, 4):
        assert (rows[i][0].n_words, rows[i][0].n_hit, rows[i][0].contaminated) == (0, 0, False)
    assert rows[7][0].n_words == 200_000
    kept = decontaminate.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, 7, 8}
    assert decontaminate.without_benchmark(docs, bench.limit(0)).count() == len(TEXTS)


def test_jaccard(docs):
    rows = by_id(jaccard.similar_documents(docs))
    assert rows[5][0].component_id == 1 and rows[5][0].n_shingles == 2
    assert rows[None][0].component_id is None
    assert rows[2][0].n_shingles == 0 and rows[2][0].component_id == 2
    assert rows[3][0].component_id == 3 and rows[4][0].component_id == 4
    assert rows[7][0].n_shingles == 1
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_one_row_of_a_repeated_key_stays(spark):
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.one_of_each(same).collect()] == [1]


def test_toxicity(docs, labels, none):
    model = toxicity.learn(docs, labels)
    rows = by_id(toxicity.score_toxicity(docs, model))
    assert rows[8][0].predicted == 1 and rows[1][0].predicted == 0
    assert rows[2][0].score == rows[3][0].score == model.rest
    assert by_id(toxicity.score_toxicity(docs, toxicity.learn(docs, labels.limit(0))))[8][0].predicted == 1
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_quality_without_labels_keeps_everything(docs, labels):
    model = resample.fit(docs, labels.limit(0))
    assert resample.selected_documents(docs, model).count() == len(TEXTS)
    assert all(r.selected for r in resample.score_quality(docs, model).collect())


def test_packing(docs):
    rows = by_id(packing.packed(docs, vocabulary()))
    assert [(r.start, r.length, r.doc_tokens) for r in rows[2]] == [(0, 1, 1)]
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 for g in rows.values() for r in g)
    assert len(rows[5]) == 2 * len(rows[1])
    everything = [r for g in rows.values() for r in g]
    assert sorted(r.sequence_id for r in everything) == list(range(len(everything)))


PAGES = [
    (1, "http://WWW.Example.com/en/x?q#f", "<p>Text &amp; more</p>"),
    (2, None, None),
    (3, "no scheme", ""),
    (4, "x://", "<div>"),
    (5, "https://a.net/es/1", "<!-- never closed"),
    (5, "https://a.net/es/1", "<!-- never closed"),
    (None, "https://net/fr/", "plain words"),
    (6, "ftp://example.com:80/en/", "<a href=\"x>unbalanced <b>q</b>" + "<div>" * 3000 + "deep words here"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_pages(spark, pages):
    rules = clashing(spark.createDataFrame(URL_RULES, "host string, path string, verdict string").drop("x"))
    judged = url_rules.judge_urls(pages, rules.select("host", "path", "verdict", "key", "size"))
    rows = by_id(judged)
    assert (rows[1][0].host, rows[1][0].path, rows[1][0].rule, rows[1][0].verdict) == (
        "www.example.com", "/en/x", "www.example.com/en/", "allow")
    for i in (2, 3, 4):
        assert (rows[i][0].host, rows[i][0].path, rows[i][0].rule, rows[i][0].verdict) == ("", "", None, "allow")
    assert len(rows[5]) == 2 and rows[5][0].verdict == "block"
    assert rows[None][0].rule == "net/fr/"
    assert rows[6][0].rule is None
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_extraction(pages):
    rows = by_id(html_text.extract_text(pages))
    assert rows[1][0].text == "Text & more" and rows[1][0].n_chars == 11
    assert rows[2][0].text == rows[3][0].text == rows[4][0].text == rows[5][0].text == ""
    assert rows[None][0].text == "plain words"
    assert "deep words here" in rows[6][0].text
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_entire_licenses(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    rows = [(k, open(f"{folder}/{f}", encoding="utf-8").read().upper().replace("\n", "\n  ")) for k, f in names.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = licenses.license_scan(docs, licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license for r in found} == {k: k for k in names}


def test_rare_insult_beside_near_copies(spark):
    words = [f"{a}{b}{c}{d}" for a in ("ba", "ce", "di", "fo", "gi", "hu", "ka", "le", "mo", "ny") for b in ("gu", "ha", "je", "ki") for c in ("lo", "mu", "na", "pe", "qui", "ru") for d in ("sa", "te", "vi", "wo", "xa", "zu", "yl", "om", "ek", "ath", "ust", "orn")]
    copied = " ".join(words)
    rows = [(i, f"{copied} number{i}", 1) for i in range(60)]
    rows += [(100 + i, f"you are a zwunkel {i}.", 1) for i in range(25)]
    rows += [(1000 + i, f"a calm report about place{i} and the weather", 0) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert any(t.startswith("zwu") for t in model.terms)
    assert len(model.terms) < 100 and model.score("you are a zwunkel") >= toxicity.TOXIC


LONG = "The harbour was rebuilt after the flood and many of the old sheds were moved to the hill behind the town. "


def paragraphs(n: int, mark: str, repeat: int = 2) -> str:
    return "".join(f"<p>{mark}{i} {LONG * repeat}</p>" for i in range(n))


def test_density_decides_against_names():
    teaser = '<article><h3><a href="/x">Another story</a></h3><p>In short.</p></article>'
    links = "<ul>" + "".join(f'<li><a href="/{i}">Topic number {i}</a></li>' for i in range(12)) + "</ul>"
    # a long text without an article element, with a teaser beside it, in it, and none
    for page in (
        f'<body><div id="story">{paragraphs(6, "a")}</div><div>{teaser}</div></body>',
        f'<body><div id="story">{paragraphs(3, "a")}{teaser}{paragraphs(3, "b")}</div></body>',
        f'<body>{links}<div id="story">{paragraphs(6, "a")}</div></body>',
    ):
        text = html_text.main_text(page)
        assert text.count("The harbour") == 12 and "Topic" not in text
    # articles in several parts, with and without wrappers of their own; a teaser among them stays away
    parts = [f"<article><h2>Part {i}</h2>{paragraphs(3, f'p{i}x')}</article>" for i in range(3)]
    for wrapper in ("", "div"):
        put = [f"<{wrapper}>{part}</{wrapper}>" if wrapper else part for part in (*parts[:2], teaser, parts[2])]
        text = html_text.main_text(f"<body>{links}<div>{''.join(put)}</div></body>")
        assert [line for line in text.split("\n") if line.startswith("Part")] == ["Part 0", "Part 1", "Part 2"]
        assert text.count("The harbour") == 18 and "In short" not in text
    # main holds the text and a list of links: the text alone
    text = html_text.main_text(f"<body><main>{links}{links}<div>{paragraphs(6, 'a')}</div></main></body>")
    assert text.count("The harbour") == 12 and "Topic" not in text
    # sections of one article, and its heading
    text = html_text.main_text(f"<body>{links}<article><h1>Head</h1><section>{paragraphs(4, 'a')}</section><section>{paragraphs(3, 'b')}</section></article></body>")
    assert text.startswith("Head") and text.count("The harbour") == 14


def test_names_of_wrappers():
    article = f'<article class="comments-open">{paragraphs(3, "a")}</article>'
    for name in ("content has-sidebar", "no-sidebar", "layout sidebar-right", "post comments-open", "social-science", "layout sidebar"):
        for inner in (article, f"<div>{paragraphs(3, 'a')}</div>"):
            page = f'<body><nav><a href="/">Home</a></nav><div class="{name}">{inner}</div><div class="sidebar">More</div></body>'
            text = html_text.main_text(page)
            assert text.count("The harbour") == 6 and "More" not in text and "Home" not in text, (name, page)
    # an article element, marked itself, and a form around the page
    assert html_text.main_text(f'<main class="social">{paragraphs(2, "a")}</main>').count("The harbour") == 4
    assert html_text.main_text(f"<form>{article}</form><footer>{LONG}</footer>").count("The harbour") == 6
    # what is around stays away, also when it is longer than the article
    page = f'<div class="ad">Buy it</div><article><p>Short.</p></article><div class="cookie-banner">Accept</div><footer>{LONG}</footer>'
    assert html_text.main_text(page) == "Short."
    assert html_text.main_text(f'<div style="display: none">{LONG * 9}</div><p>Short.</p>') == "Short."


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (9, []),
    ]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = nearest.nearest_vectors(table, table.where("vec_id = 1"), k=20)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, 1, 2, 1.0), (1, 2, 3, 0.0)]
    assert nearest.nearest_vectors(table.limit(0), table).count() == 0


def test_fold_of_text_keys(spark):
    import zlib

    keys = spark.range(50).select("id", labelled.fold(F.col("id")).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 3 for r in keys)


def test_one_of_each_judges_rows_by_key_and_set(spark):
    """Repeated keys with different texts, a null text, ties and a near copy of a smaller key."""
    rows = [
        (1, "a b c d e f"),
        (1, "x y z w v u"),
        (1, None),
        (1, "a b c d e f"),
        (2, "a b c d e f"),
        (3, "x y z w v u"),
        (3, ""),
        (None, "a b c d e f"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0), r.text or "") for r in jaccard.one_of_each(frame).collect())
    assert kept == [(0, "a b c d e f"), (1, ""), (1, "a b c d e f"), (1, "x y z w v u"), (3, "")]
