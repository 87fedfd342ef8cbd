"""The same results in SQL for DuckDB, written from the given tables alone."""

from __future__ import annotations

from marketlens import fixed_values as fv

_STOP = ", ".join(f"'{w}'" for w in fv.STOPWORDS)

# Rounding goes through printf, which starts from the exact stored number.

# The text a repaired review must have, straight from the undamaged document.
_TIDY = r"trim(regexp_replace(d.text, '\s+', ' ', 'g'))"
_SHARE = (
    r"length(regexp_replace({0}, '[^A-Za-z]', '', 'g'))::DOUBLE"
    r" / nullif(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')), 0)"
)

_REVIEWS = rf"""
WITH base AS (
  SELECT d.source AS "ASIN", d.doc_id, 'About ' || d.lang AS review_title,
    CASE WHEN l.quality = 1 THEN 5.0::DOUBLE WHEN l.quality = 0 THEN 1.0::DOUBLE END AS rating,
    CASE WHEN d.source = 'src3' THEN {_TIDY} || ' Ø'
         WHEN d.source = 'src5' THEN '' ELSE {_TIDY} END AS review_text,
    d.n_chars % 50 AS helpful, coalesce(l.toxic = 0, false) AS verified
  FROM documents d LEFT JOIN labels l USING (doc_id)
), tagged AS MATERIALIZED (
  SELECT *, CASE WHEN review_text = '' THEN 'empty_review_text'
    WHEN review_text LIKE '%Ø%'
      OR coalesce({_SHARE.format("(review_title || ' ' || review_text)")}, 0) < 0.9
      THEN 'garbled_or_non_english' END AS drop_reason FROM base
), kept AS MATERIALIZED (
  SELECT *, length(review_text) AS chars,
    CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' END AS polarity,
    list_filter(regexp_extract_all(lower(review_text), '[a-z0-9]{{3,}}'),
      lambda w: w NOT IN ({_STOP})) AS tokens
  FROM tagged WHERE drop_reason IS NULL
), words AS (SELECT polarity, unnest(tokens) AS word FROM kept
), bigrams AS (
  SELECT polarity, unnest(list_transform(range(1, len(tokens)),
    lambda i: tokens[i] || ' ' || tokens[i + 1])) AS bigram FROM kept
), hits AS (
  SELECT doc_id, polarity, 'ther' AS theme FROM kept
    WHERE contains(lower(review_text), 'ther') OR contains(lower(review_text), 'xyzzy')
  UNION ALL SELECT doc_id, polarity, 'tion' FROM kept WHERE contains(lower(review_text), 'tion')
  UNION ALL SELECT doc_id, polarity, 'rewh' FROM kept
    WHERE contains(lower(review_text), 'rewh') OR contains(lower(review_text), 'etwas')
)
"""

_STATS = """
  SELECT count(*) AS total_reviews, count(DISTINCT "ASIN") AS unique_asins,
    printf('%.2f', count(*)::DOUBLE / count(DISTINCT "ASIN"))::DOUBLE AS avg_reviews_per_asin,
    printf('%.4f', avg(verified::INT))::DOUBLE AS verified_purchase_rate,
    printf('%.1f', sum(chars)::DOUBLE / count(*))::DOUBLE AS avg_review_char_length,
    printf('%.1f', sum(len(tokens))::DOUBLE / count(*))::DOUBLE AS avg_review_word_count
  FROM kept
"""
_LENGTHS = """
  SELECT rating AS review_rating_value, printf('%.1f', sum(chars)::DOUBLE / count(*))::DOUBLE AS avg_length,
    count(*) AS n FROM kept WHERE rating IS NOT NULL GROUP BY rating
"""
_COVERAGE = """
  SELECT count(*) AS total_asins_attempted, count_if(event_type = 'error') AS captcha_rows,
    (sum(trunc(value)) FILTER (WHERE event_type <> 'click'))::BIGINT AS review_count_sum,
    printf('%.4f', count_if(event_type = 'error')::DOUBLE / count(*))::DOUBLE AS captcha_rate
  FROM events
"""
_TRACES = """
  SELECT CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS status_trace,
    count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, status_trace LIMIT 5
"""


def _top(kind: str, column: str, side: str, k: int) -> str:
    return (
        f"SELECT {column}, count(*) AS n FROM {kind} WHERE polarity = '{side}' "
        f"GROUP BY 1 ORDER BY n DESC, {column} LIMIT {k}"
    )


def _as_entries(section: str, name: str, value: str, source: str) -> str:
    return (
        f"SELECT '{section}' AS section, {name} AS name, {value}::DOUBLE AS value FROM ({source})"
    )


def _placed(listed: str, name: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY n DESC, {name}) AS place FROM ({listed})"


_SUMMARY = " UNION ALL ".join(
    [
        *(
            _as_entries("review_stats", f"'{c}'", c, _STATS)
            for c in (
                "total_reviews", "unique_asins", "avg_reviews_per_asin",
                "verified_purchase_rate", "avg_review_char_length", "avg_review_word_count",
            )
        ),
        *(
            _as_entries("crawl_status", f"'{c}'", c, _COVERAGE)
            for c in ("total_asins_attempted", "captcha_rows", "review_count_sum", "captcha_rate")
        ),
        *(
            _as_entries("cleaning_filters", f"'{reason}'", "n",
                        f"SELECT count_if(drop_reason = '{reason}') AS n FROM tagged")
            for reason in (fv.EMPTY_REVIEW, fv.UNREADABLE_REVIEW)
        ),
        _as_entries("rating_distribution", "review_rating_value::VARCHAR", "n", _LENGTHS),
        _as_entries("rating_length_summary", "review_rating_value::VARCHAR", "avg_length", _LENGTHS),
        _as_entries("painpoint_counts", "theme", "n",
                    "SELECT theme, count(*) AS n FROM hits GROUP BY 1"),
        _as_entries("status_trace_top", "status_trace", "n", _TRACES),
        *(
            _as_entries(f"{side}_top_words", "word", "n", _top("words", "word", side, 20))
            for side in ("positive", "negative")
        ),
        *(
            _as_entries(f"{side}_top_bigrams", "bigram", "n", _top("bigrams", "bigram", side, 15))
            for side in ("positive", "negative")
        ),
        *(
            _as_entries(f"headline_{side}_words", "word", "place", _placed(_top("words", "word", side, 5), "word"))
            for side in ("positive", "negative")
        ),
        _as_entries("headline_themes", "theme", "place", _placed(
            "SELECT theme, count(*) AS n FROM hits GROUP BY 1 ORDER BY n DESC, theme LIMIT 4", "theme")),
    ]
)


def _histogram_edges(table: str, column: str) -> str:
    return (
        f"e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {table}), "
        "bins AS (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / 10) AS left_edge, "
        "CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS right_edge "
        "FROM e, range(1, 11) AS r(i))"
    )


def _density(table: str, column: str) -> str:
    return f"""
WITH s AS (SELECT count(*) AS n, min({column}) AS lo, max({column}) AS hi,
    stddev_samp({column}) * power(count(*), -0.2) AS width FROM {table}),
g AS (SELECT i AS point, lo + i * ((hi - lo) / 199) AS x FROM s, range(0, 200) AS r(i)),
d AS (SELECT g.point, g.x, sum(exp(-0.5 * power((g.x - t.{column}) / s.width, 2)))
    / (any_value(s.n) * any_value(s.width) * sqrt(2 * pi())) AS density,
    any_value(s.n * (s.hi - s.lo) / 10) AS unit
  FROM g, s, {table} t GROUP BY g.point, g.x)
SELECT point, round(x, 6) AS x, round(density, 9) AS density,
  round(density * unit, 4) AS scaled FROM d"""


def _box(table: str, brand: str, price: str, rest: str) -> str:
    return f"""
WITH top AS (SELECT {brand} AS b FROM {table} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
p AS (SELECT {brand} AS "Brand", {price} AS v FROM {table} WHERE {brand} IN (SELECT b FROM top)),
q AS (SELECT "Brand", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
    quantile_cont(v, 0.75) AS q3 FROM p GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
{rest}"""


_BOX_ROWS = """
SELECT "Brand", n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(least(min(v) FILTER (WHERE v >= low), q1), 4) AS whisker_low,
  round(greatest(max(v) FILTER (WHERE v <= high), q3), 4) AS whisker_high,
  count(*) FILTER (WHERE v < low OR v > high) AS outliers
FROM p JOIN f USING ("Brand") GROUP BY "Brand", n, q1, median, q3, low, high"""

_MIXED = """
  CASE p_type WHEN 'MEDIUM' THEN p_size::DOUBLE WHEN 'STANDARD' THEN p_size + 0.9::DOUBLE
    WHEN 'LARGE' THEN -(p_size + 0.9::DOUBLE) END"""

_PRODUCTS = r"""
  SELECT p_partkey AS "ASIN", upper(p_name) AS "Title",
    CASE WHEN p_size <> 7 THEN '$' || printf('%.2f', p_retailprice) END AS "Price",
    p_brand AS "Brand", CASE WHEN p_size <> 7 THEN round(p_retailprice, 2) END AS "Price_Clean",
    lower(p_name) AS "Title_Lower"
  FROM part WHERE regexp_matches(p_name, '(?i)red\s*widget')"""

# Pages without comments, scripts and style sheets; links of the rest.
_PAGE = (
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),"
    r" '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g')"
)
_PAGES = rf"""
WITH p AS (SELECT page_id, {_PAGE} AS page FROM pages),
l AS (SELECT page_id, page,
  regexp_extract_all(page, '<a[^>]*? href="([^"]*)"', 1) AS links FROM p)
"""
# First-seen order without repeats.
_UNIQUE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


#: A paragraph up to its end tag or the end of the article.
_CUT = r"regexp_extract({0}, '(?s)^(.*?)(?:</p\s*>|</article|\z)', 1)"


def _text(tag: str) -> str:
    return _text_of(rf"regexp_extract(page, '(?s)<{tag}[^>]*>(.*?)</{tag.split()[0]}>', 1)")


def _text_of(inner: str) -> str:
    bare = rf"trim(regexp_replace({inner}, '\s*<[^>]*>\s*', '', 'g'))"
    for code, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        bare = f"replace({bare}, '{code}', '{char}')"
    return bare


def _keyword_rows(rest: str) -> str:
    rules = {
        "of the": (["of", "the"], r"\bof\b.*\bthe\b"),
        "and that": (["and", "that"], r"\band\b.*\bthat\b"),
        "the on": (["the", "on"], r"\bthe\b.*\bon\b"),
        "der": (["der"], r"\bder\b"),
        "les de": (["les", "de"], r"\bles\b.*\bde\b"),
    }
    cells = " UNION ALL ".join(
        f"SELECT listing_id, '{k}' AS keyword, CASE WHEN regexp_matches(words, '{pattern}') "
        f"THEN 'Yes' WHEN "
        + " AND ".join(rf"regexp_matches(words, '\b{w}\b')" for w in words)
        + " THEN 'Partial' ELSE 'No' END AS coverage, list_filter(list_transform(bullets, "
        "lambda b, i: CASE WHEN "
        + " AND ".join(rf"regexp_matches(b, '\b{w}')" for w in words)
        + " THEN i END), lambda i: i IS NOT NULL) AS numbers FROM t"
        for k, (words, pattern) in rules.items()
    )
    # RE2 word borders are ASCII, so other letters become blanks and digits stay.
    plain = r"regexp_replace(lower({0}), '[^a-z0-9]', ' ', 'g')"
    return rf"""{_PAGES}, t AS (SELECT page_id AS listing_id, {plain.format(_text("title"))} AS words,
  list_transform(string_split_regex(page, '<p(?:\s[^>]*)?>')[2:],
    lambda b: {plain.format(_text_of(_CUT.format("b")))}) AS bullets FROM l),
c AS ({cells}) {rest}"""


_ITEM = "lpad(p_partkey::VARCHAR, 10, 'B')"
_TITLE = "CASE WHEN p_size <> 3 THEN p_name || '& more' ELSE '{0}' END"
_PRICE = "printf('%.2f', p_retailprice)"
_STARS = "(p_size % 5 + 1)::VARCHAR || '.0 out of 5 stars'"

_DETAILS = f"""SELECT {_ITEM} AS "ASIN",
  CASE WHEN NOT blocked THEN {_TITLE.format("N/A")} END AS "Title",
  CASE WHEN NOT blocked THEN CASE WHEN p_size = 4 THEN '$' ELSE '' END || {_PRICE} END AS "Price",
  CASE WHEN NOT blocked THEN {_STARS} END AS "Rating",
  CASE WHEN NOT blocked THEN p_size || ' ratings' END AS "Reviews",
  CASE WHEN NOT blocked THEN p_brand END AS "Brand",
  CASE WHEN NOT blocked AND p_size <> 4 THEN '1' || p_partkey END AS "BSR",
  CASE WHEN blocked THEN 'Failed to Fetch Detail' WHEN p_size = 4 THEN 'Parse Error'
    ELSE 'Success' END AS "Status" FROM (SELECT *, p_size IN (1, 2) AS blocked FROM part)"""

ORACLE: dict[str, str] = {
    "mojibake_repair": rf"""SELECT doc_id, md5({_TIDY}) AS once_md5, md5({_TIDY}) AS twice_md5
FROM documents d""",
    # Each marker but one is the first byte of a UTF-8 sequence for these ranges.
    "garbled_flag": r"""SELECT doc_id, text = '' OR regexp_matches(text,
  '[\x{C0}-\x{FF}\x{600}-\x{67F}\x{2000}-\x{3FFF}\x{10000}-\x{3FFFF}]') AS damaged_is_garbled,
  text = '' OR regexp_matches(text, '[ã\x{FFFD}ÙØÃâð]') AS text_is_garbled FROM documents""",
    "ascii_letter_ratio": rf"""SELECT doc_id, round({_SHARE.format('text')}, 6) AS share,
  coalesce({_SHARE.format('text')} >= 0.9, false) AS mostly_english FROM documents""",
    "rating_parse": "SELECT l_orderkey, l_linenumber, l_quantity AS rating FROM lineitem",
    "helpful_count": """SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE p_size END::BIGINT
  AS helpful_count FROM part""",
    "price_parse": """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price
FROM lineitem""",
    "numeric_coerce": f"""SELECT p_partkey, {_MIXED} AS number, trunc({_MIXED})::BIGINT AS whole
FROM part""",
    "drop_reasons": f"""{_REVIEWS} SELECT count_if(drop_reason = 'empty_review_text')
  AS empty_review_text, count_if(drop_reason = 'garbled_or_non_english') AS garbled_or_non_english,
  count_if(drop_reason IS NULL) AS kept FROM tagged""",
    "clean_reviews": f"""{_REVIEWS} SELECT "ASIN", doc_id::VARCHAR AS review_id,
  '1' AS review_page, review_title,
  CASE rating WHEN 5 THEN '5.0 out of 5 stars' WHEN 1 THEN '1.0 out of 5 stars' ELSE '' END
    AS review_rating_text, rating AS review_rating_value, 'Reviewed in 2024' AS review_date,
  review_text, chars AS review_char_length, len(tokens) AS review_word_count,
  helpful || ' people found this helpful' AS helpful_text, helpful AS helpful_count,
  CASE WHEN verified THEN 'Yes' ELSE 'no' END AS is_verified_purchase FROM kept""",
    **{
        f"top_words_{side}": f"{_REVIEWS} {_top('words', 'word', side, 20)}"
        for side in ("positive", "negative")
    },
    **{
        f"top_bigrams_{side}": f"{_REVIEWS} {_top('bigrams', 'bigram', side, 15)}"
        for side in ("positive", "negative")
    },
    "theme_counts": f"{_REVIEWS} SELECT theme, count(*) AS n FROM hits GROUP BY 1",
    "theme_polarity": f"""{_REVIEWS} SELECT theme, count_if(polarity = 'positive') AS positive,
  count_if(polarity = 'negative') AS negative, count_if(polarity IS NULL) AS neither
  FROM hits GROUP BY 1""",
    "review_stats": f"{_REVIEWS} {_STATS}",
    "rating_distribution": f"""{_REVIEWS} SELECT rating AS review_rating_value, count(*) AS n
  FROM kept WHERE rating IS NOT NULL GROUP BY 1""",
    "length_by_rating": f"{_REVIEWS} {_LENGTHS}",
    "crawl_coverage": _COVERAGE,
    "status_top5": _TRACES,
    "review_summary": f"{_REVIEWS} {_SUMMARY}",
    "summary_json": f"{_REVIEWS} {_SUMMARY}",
    "product_filter": f'SELECT * FROM ({_PRODUCTS}) WHERE "Price_Clean" IS NOT NULL',
    "product_filter_counts": f"""SELECT count(*) AS found, count_if("Price_Clean" IS NULL) AS dropped,
  count("Price_Clean") AS kept FROM ({_PRODUCTS})""",
    "scatter_points": f"""SELECT CASE WHEN p_type <> 'PROMO' THEN p_size::DOUBLE END
  AS "Reviews_Clean", {_STARS} AS "Rating",
  CASE WHEN p_size <> 7 THEN round(p_retailprice, 2) END AS "Price_Clean" FROM part""",
    "scatter_points_extracted": """SELECT p_size::DOUBLE AS "Reviews_Clean",
  (p_size % 5 + 1)::DOUBLE AS "Rating",
  CASE WHEN p_size <> 7 THEN round(p_retailprice, 2) END AS "Price_Clean" FROM part""",
    "price_histogram": f"""WITH {_histogram_edges("lineitem", "l_extendedprice")}
SELECT bin, round(left_edge, 4) AS left_edge, round(right_edge, 4) AS right_edge, count(v) AS n
FROM bins LEFT JOIN (SELECT l_extendedprice AS v FROM lineitem)
  ON v >= left_edge AND (v < right_edge OR bin = 10) GROUP BY 1, 2, 3""",
    "price_density": _density("part", "p_retailprice"),
    "value_density": _density("events", "value"),
    "brand_top10": """SELECT p_brand AS "Brand", count(*) AS n FROM part
GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
    "brand_box_top5": _box("part", "p_brand", "p_retailprice", _BOX_ROWS),
    "line_price_box": _box("lineitem", "l_returnflag", "l_extendedprice", _BOX_ROWS),
    "value_box": _box("events", "event_type", "value", _BOX_ROWS),
    "value_outliers": _box("events", "event_type", "value", """
SELECT "Brand", v AS "Price_Clean", count(*) AS n FROM p JOIN f USING ("Brand")
WHERE v < low OR v > high GROUP BY 1, 2"""),
    "price_band_share": """SELECT count(*) AS products,
  count_if(l_extendedprice BETWEEN 5000 AND 20000) AS in_band,
  round(avg((l_extendedprice BETWEEN 5000 AND 20000)::INT), 6) AS share FROM lineitem""",
    "brand_share": """SELECT p_brand AS "Brand", count(*) AS n,
  round(count(*) / (SELECT count(p_brand) FROM part)::DOUBLE, 6) AS share
FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
    "page_links": f"""{_PAGES} SELECT page_id, i AS position, links[i] AS href
FROM l, unnest(range(1, len(links) + 1)) AS r(i)""",
    "page_ids_fallback": rf"""{_PAGES}, a AS (SELECT page_id,
  list_filter(links, lambda x: length(x) = 4) AS first,
  list_filter(list_transform(links, lambda x: regexp_extract(x, '/([a-z]{{2}})', 1)),
    lambda x: x <> '') AS second, page FROM l),
u AS (SELECT page_id, {_UNIQUE.format("first")} AS first, second FROM a),
c AS (SELECT page_id, CASE WHEN len(first) < 2 THEN list_concat(first, second) ELSE first END AS ids
  FROM u),
k AS (SELECT page_id, ({_UNIQUE.format("ids")})[1:5] AS ids FROM c)
SELECT page_id, i AS position, ids[i] AS "ASIN", 'https://www.amazon.com/dp/' || ids[i] AS detail_url
FROM k, unnest(range(1, len(ids) + 1)) AS r(i)""",
    "page_ids_all": rf"""{_PAGES}, a AS (SELECT page_id, list_concat(
  list_filter(links, lambda x: length(x) = 4),
  list_filter(list_transform(links, lambda x: regexp_extract(x, '/([a-z]{{2}})', 1)),
    lambda x: x <> '')) AS ids FROM l),
k AS (SELECT page_id, {_UNIQUE.format("ids")} AS ids FROM a)
SELECT page_id, i AS position, ids[i] AS "ASIN", 'https://www.amazon.com/dp/' || ids[i] AS detail_url
FROM k, unnest(range(1, len(ids) + 1)) AS r(i)""",
    "page_ids_distinct": rf"""{_PAGES} SELECT DISTINCT id AS "ASIN" FROM (
  SELECT unnest(list_transform(links, lambda x: regexp_extract(x, '/([a-z]{{3}})', 1))) AS id FROM l)
WHERE id <> ''""",
    "page_ids_segments": rf"""{_PAGES}, a AS (SELECT page_id, list_filter(
  flatten(list_transform(links, lambda x: string_split(x, '/'))),
  lambda x: length(x) = 5 AND regexp_matches(x, '^[\p{{L}}\p{{Nd}}]')) AS ids FROM l),
k AS (SELECT page_id, {_UNIQUE.format("ids")} AS ids FROM a)
SELECT page_id, i AS position, ids[i] AS "ASIN", 'https://www.amazon.com/dp/' || ids[i] AS detail_url
FROM k, unnest(range(1, len(ids) + 1)) AS r(i)""",
    "page_fields": f"""{_PAGES} SELECT page_id, {_text("title")} AS title, {_text("h1")} AS heading,
  {_text('div class="ad"')} AS ad, {_text("footer")} AS footer, {_text("ul")} AS list,
  'N/A' AS aside FROM l""",
    "page_status": """SELECT page_id, CASE WHEN contains(lower(html), 'lang="de"')
  OR contains(lower(html), 'nicht aulich') THEN 'Failed to Fetch Detail' ELSE 'Success' END AS status
FROM pages""",
    "blocked_rate": """SELECT count(*) AS pages, count_if(contains(lower(html), 'nicht aulich'))
  AS blocked, round(avg(contains(lower(html), 'nicht aulich')::INT), 6) AS blocked_rate FROM pages""",
    "item_details": _DETAILS,
    "item_harvest": f"""WITH items AS (SELECT p_partkey AS key FROM part
  UNION SELECT p_partkey + 1 FROM part), details AS ({_DETAILS})
SELECT lpad(key::VARCHAR, 10, 'B') AS "ASIN", "Title", "Price", "Rating", "Reviews", "Brand", "BSR",
  coalesce("Status", 'Failed to Fetch Detail') AS "Status"
FROM items LEFT JOIN details ON lpad(key::VARCHAR, 10, 'B') = "ASIN" """,
    "item_status_counts": """SELECT CASE WHEN p_size IN (1, 2) THEN 'Failed to Fetch Detail'
  WHEN p_size = 4 THEN 'Parse Error' ELSE 'Success' END AS "Status", count(*) AS n
FROM part GROUP BY 1""",
    "item_details_quick": f"""SELECT {_ITEM} AS "ASIN", {_TITLE.format("")} AS "Title",
  '$' || {_PRICE} || 'now' AS "Price", {_STARS} AS "Rating", p_size || ' ratings' AS "Reviews",
  'https://www.amazon.com/dp/' || {_ITEM} AS "URL" FROM part WHERE p_size <> 2""",
    "item_details_union": f"""SELECT {_ITEM} AS "ASIN",
  CASE WHEN p_size <> 2 THEN {_TITLE.format("")} END AS "Title",
  CASE WHEN p_size <> 2 THEN {_STARS} END AS "Rating",
  CASE WHEN p_size = 2 THEN 'no page' END AS "Error" FROM part""",
    "keyword_coverage": _keyword_rows("SELECT listing_id, keyword, coverage FROM c"),
    "keyword_hits": _keyword_rows("SELECT listing_id, keyword, coverage FROM c WHERE coverage <> 'No'"),
    "keyword_coverage_totals": _keyword_rows(
        "SELECT keyword, coverage, count(*) AS n FROM c GROUP BY 1, 2"
    ),
    "keyword_placement": _keyword_rows("""SELECT listing_id, keyword, coverage = 'Yes' AS in_title,
  array_to_string(list_concat(CASE WHEN coverage = 'Yes' THEN ['Title'] ELSE [] END,
    list_transform(numbers, lambda i: 'Bullet ' || i)), ' + ') AS placement FROM c"""),
    "placement_counts": """SELECT unnest(string_split(p_name, ' ')) AS placement, count(*) AS n
FROM part GROUP BY 1""",
    "keyword_tiers": """SELECT p_type AS "Category", CASE WHEN p_size <= 10 THEN 'Low'
  WHEN p_size <= 30 THEN 'Medium' ELSE 'High' END AS "Priority", count(*) AS n
FROM part GROUP BY 1, 2""",
}
