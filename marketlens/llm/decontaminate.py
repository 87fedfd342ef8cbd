"""Benchmark passages in documents, by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import map_columns

#: Words of one window.
WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Benchmark bytes that one search holds; a larger benchmark is searched in so many more passes.
PATTERN_BYTES = 32 << 20

#: A-Z to a-z, digits and bytes from 0x80 stay, every other byte parts words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none of null."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WordSearch:
    """Tables of a Wu-Manber search, one set for each pattern length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        patterns: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                patterns[size][tuple(words[i : i + size])].add(item)
        self.tables = []
        for size, found in sorted(patterns.items()):
            block = min(BLOCK, size)
            shift: dict[tuple, int] = {}
            buckets = defaultdict(list)
            for pattern, owners in found.items():
                for end in range(block, size + 1):
                    at = pattern[end - block : end]
                    shift[at] = min(shift.get(at, size), size - end)
                buckets[pattern[-block:]].append((pattern[0], list(pattern), sorted(owners)))
            self.tables.append((size, block, shift, dict(buckets)))

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged word spans of all occurrences, and the items that occur."""
        spans: list[list[int]] = []
        items: set = set()
        for size, block, shift, buckets in self.tables:
            far, last, i = size - block + 1, len(words), size
            while i <= last:
                at = tuple(words[i - block : i])
                step = shift.get(at, far)
                if step:
                    i += step
                    continue
                start = i - size
                for first, pattern, owners in buckets[at]:
                    if words[start] == first and words[start:i] == pattern:
                        items.update(owners)
                        if spans and spans[-1][0] <= start <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], i)
                        else:
                            spans.append([start, i])
                i += 1
        return merged(spans), items


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _searches(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> list[WordSearch]:
    """The benchmark in blocks of bounded bytes; only one block is held at a time while building."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [WordSearch([tuple(r) for r in rows.where(part == b).collect()], window) for b in range(blocks)]


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    window: int = WINDOW,
    pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """Every occurrence of a benchmark window in every document.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. The
    shift table skips word positions at which no window can end, a bucket of the last two words
    picks the windows to test, and comparing all words confirms them. The benchmark is the query
    side: it is searched in blocks of ``pattern_bytes``, one scan each, and never joined by pairs.

    Returns ``key, n_words, spans, items``: merged [start, end) word spans covered by occurrences,
    and the sorted distinct item ids as strings. Null and empty texts have no words and no spans;
    items without words or without an id never occur; repeated items count once; equal rows give
    equal rows; other columns are not read. An empty benchmark hits nothing.
    """
    context = documents.sparkSession.sparkContext
    found = documents.select(
        F.col(key).alias("key"), F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    kind = documents.schema[key].dataType.simpleString()
    searches = _searches(benchmark, item, "text" if "text" in benchmark.columns else text, window, pattern_bytes)
    for last, search in [(b == len(searches) - 1, s) for b, s in enumerate(searches)]:
        held = context.broadcast(search)

        def scan(keys, texts, _, spans, items, held=held, last=last):
            made = {"key": keys, "text": texts, "n_words": [], "spans": [], "items": []}
            for body, old, names in zip(texts, spans, items):
                words = words_of(body)
                here, more = held.value.find(words)
                made["n_words"].append(len(words))
                made["spans"].append(merged(old + here) if old else here)
                made["items"].append(sorted({*names, *more}))
            return made

        body = "" if last else "text string, "
        found = map_columns(
            found, f"key {kind}, {body}n_words long, spans array<array<int>>, items array<string>", scan
        )
    return found.withColumnRenamed("key", key)


def contamination(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and a digest of ``benchmark_hits``."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))
    return hits.select(
        key,
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_benchmark(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents in which no benchmark window occurs; their columns pass through.

    Null and empty texts stay. A benchmark of several blocks takes one scan for each.
    """
    from marketlens.llm.tables import filter_rows

    context = documents.sparkSession.sparkContext
    kept = documents
    for search in _searches(benchmark, "item_id", "text", WINDOW, PATTERN_BYTES):
        held = context.broadcast(search)
        kept = filter_rows(
            kept, [text], lambda texts, held=held: [not held.value.find(words_of(t))[0] for t in texts]
        )
    return kept
