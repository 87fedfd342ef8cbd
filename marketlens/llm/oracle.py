"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

#: The crc table is made by rule; each byte is one step of the reduction.
OP1 = """
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
bytes AS (
  SELECT text, hex(encode(text)) AS h, octet_length(encode(text)) AS n
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
lists AS (
  SELECT text, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM bytes),
crcs AS (
  SELECT text, xor(4294967295, list_reduce(b,
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS crc
  FROM lists, steps),
placed AS (
  SELECT doc_id, octet_length(encode(coalesce(d.text, ''))) + 1 AS size, crc
  FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '')),
summed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS through,
    CAST(sum(size) OVER () AS BIGINT) AS everything
  FROM placed),
cut AS (SELECT *, CAST(least(7, (2 * through - size) * 8 // (2 * everything)) AS INT) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""

_RULES = """
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
"""

OP3 = f"""
WITH {_RULES},
split AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS mark, coalesce(url, '') AS url FROM pages),
hosts AS (
  SELECT page_id,
    translate(CASE WHEN mark = 0 THEN '' ELSE regexp_extract(substr(url, mark + 3), '^[^/?#]*') END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN mark = 0 THEN '' ELSE regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM split),
numbered AS (SELECT row_number() OVER () AS n, * FROM hosts),
fit AS (
  SELECT n, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS place
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN fit ON fit.n = numbered.n AND place = 1
"""

OP5 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
patterns AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS pattern
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
  SELECT r, i, size, list_slice(w, i, i + size - 1) AS pattern
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT r, i, windows.size, item FROM windows JOIN patterns USING (pattern)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS word FROM found) GROUP BY r),
which AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN which USING (r)
"""

ORACLE: dict[str, str] = {"op1_sharding": OP1, "op3_url_filter": OP3, "op5_decontamination": OP5}

_SPELT = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPELT = f"regexp_replace({_SPELT}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', '\\1', 'g')"


def _canonical(text: str) -> str:
    from marketlens.llm.licenses import SPELLINGS

    form = _SPELT.replace("{text}", text)
    for spelling, one in SPELLINGS:
        form = f"replace({form}, '{spelling}', '{one}')"
    return f"trim(regexp_replace({form}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"


def _op6() -> str:
    from marketlens.llm.licenses import KNOWN

    known = ", ".join(f"('{name}', '{text}')" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT form, min(license) AS license
  FROM (SELECT license, {_canonical('text')} AS form FROM (VALUES {known}) AS v(license, text))
  WHERE form <> '' GROUP BY form),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {_canonical('text')} AS form FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
found AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n
  FROM (SELECT r, {_canonical('line')} AS form FROM lines) JOIN known USING (form) GROUP BY r)
SELECT doc_id, sha256(form) AS digest, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines
FROM docs LEFT JOIN known USING (form) LEFT JOIN found USING (r)
"""


ORACLE["op6_license_scan"] = _op6()


#: Terms, statistics and the integer score spelled out; each row of documents is one document.
OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS big_n, sum(len(terms)) AS big_l FROM docs),
postings AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT item_id, a.term, CAST(floor(1000 * ln((2.0 * big_n + 2) / (2.0 * df + 1))) AS BIGINT) AS w
  FROM asked a JOIN freq f ON a.term = f.term, totals),
lengths AS (SELECT r, CAST(50 + (50 * len(terms) * big_n) // big_l AS BIGINT) AS m FROM docs, totals),
scored AS (
  SELECT item_id, p.r, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score
  FROM weights w JOIN postings p ON p.term = w.term JOIN lengths l ON l.r = p.r
  GROUP BY item_id, p.r, p.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""
ORACLE["op13_lexical_search"] = OP13
