"""Token counts of a byte-level BPE by a map-side two-tier lookup of pre-token lengths.

A byte-level BPE merges only inside a pre-token, so a text's count is the number of special tokens
in it plus the sum of its pre-tokens' BPE lengths. Tier one is a compact table of the lengths of
frequent pre-tokens, counted on a bounded sample and broadcast; tier two is a cache that each task
owns, filled by encoding the misses of a group of documents in one call. Every document is counted in the map task that
reads it: no pre-token is shuffled, and the tables are bounded in entries and bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import no_null

#: Documents whose pre-tokens are counted for the frequent table (a bounded sample; only speed).
SAMPLE_ROWS = 20_000
#: UTF-8 bytes of text that the sample reads at most.
SAMPLE_BYTES = 64 << 20
#: Entries of the broadcast table, and the longest pre-token it holds, in characters.
TABLE_ENTRIES = 100_000
TABLE_KEY_CHARS = 24
#: Text whose pre-tokens are looked up together, so that misses are encoded in one call.
GROUP_BYTES = 4 << 20
#: Entries a task's cache holds before it starts afresh; pre-tokens encoded at once.
CACHE_ENTRIES = 200_000
MISS_BATCH = 20_000
#: Tokens above which a document is over the limit.
LIMIT = 512


class PreTokens:
    """The special strings and the pre-token pattern of a ``tokenizers`` file.

    Special tokens are matched as the library does by default (``encode_special_tokens`` off): an
    occurrence in a text is one token, whatever surrounds it. Tokens with ``lstrip``, ``rstrip`` or
    ``single_word`` are not handled and are refused.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only a byte-level pre-tokenizer without a prefix space is handled")
        if spec.get("normalizer"):
            raise ValueError("only a tokenizer without a normalizer is handled")
        specials = [t for t in spec.get("added_tokens", []) if t.get("special")]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in specials):
            raise ValueError("special tokens with stripping or word bounds are not handled")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        names = sorted((t["content"] for t in specials), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def split(self, text: str) -> tuple[int, list[str]]:
        """The number of special tokens in ``text`` and its other pre-tokens, in order."""
        parts = self.special.split(text) if self.special else [text]
        found = self.pattern.findall
        return len(parts) - 1, [piece for part in parts for piece in found(part)]


def frequent_lengths(documents: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Tier one: BPE lengths of the most frequent short pre-tokens of a bounded sample.

    The sample is a Bernoulli sample of about ``SAMPLE_ROWS`` rows, read up to ``SAMPLE_BYTES``, so
    that only sampled rows are sent to the counting task; it only chooses what is looked up first,
    so results do not depend on it. Counting and encoding run in one task; the
    driver receives at most ``TABLE_ENTRIES`` keys of at most ``TABLE_KEY_CHARS`` characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        cut, seen, read = PreTokens(path), Counter(), 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if read < SAMPLE_BYTES and body:
                    seen.update(p for p in cut.split(body)[1] if len(p) <= TABLE_KEY_CHARS)
                    read += len(body)
        keys = [p for p, _ in seen.most_common(TABLE_ENTRIES)]
        tokenizer = Tokenizer.from_file(path)
        lengths = [len(e.ids) for e in tokenizer.encode_batch_fast(keys, add_special_tokens=False)] if keys else []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lengths, pa.int32())], ["piece", "n"])

    rows = documents.count()
    share = min(1.0, 1.25 * SAMPLE_ROWS / max(rows, 1))
    sample = documents.select(no_null(text).alias("text")).sample(fraction=share, seed=11).limit(SAMPLE_ROWS)
    return {row.piece: row.n for row in sample.mapInArrow(count, "piece string, n int").collect()}


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row, in the tokenizer at ``path``.

    Counts equal ``len(encode(text, add_special_tokens=False).ids)`` without truncation or padding.
    A null text counts as empty: 0 bytes, 0 tokens. Rows are kept as they come, repeated ones too;
    other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    table = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, path, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        cut, known = PreTokens(path), table.value
        tokenizer = Tokenizer.from_file(path)
        lookup = dict(known)  # tier one, then the misses this task has encoded

        def counted(bodies: list[str]) -> list[int]:
            nonlocal lookup
            split = [cut.split(body) for body in bodies]
            missed = {p for _, pieces in split for p in pieces if p not in lookup}
            if len(lookup) + len(missed) > len(known) + CACHE_ENTRIES:
                lookup = dict(known)
                missed = {p for _, pieces in split for p in pieces if p not in lookup}
            missed = list(missed)
            for i in range(0, len(missed), MISS_BATCH):
                chunk = missed[i : i + MISS_BATCH]
                for piece, made in zip(chunk, tokenizer.encode_batch_fast(chunk, add_special_tokens=False)):
                    lookup[piece] = len(made.ids)
            return [specials + sum(map(lookup.__getitem__, pieces)) for specials, pieces in split]

        for batch in batches:
            counts, bodies, held = [], [], 0
            for body in batch.column(1).to_pylist():
                bodies.append(body)
                held += len(body)
                if held > GROUP_BYTES:
                    counts += counted(bodies)
                    bodies, held = [], 0
            counts += counted(bodies)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    kind = documents.schema[key].dataType.simpleString()
    framed = documents.select(
        F.col(key).alias("key"), no_null(text).alias("text"), F.octet_length(no_null(text)).cast("long").alias("n_bytes")
    )
    return framed.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit")
    )
