"""Sequences of one document each: power-of-two pieces, bucketed by length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import durable, task_scoped

#: Tokens of the longest sequence, a power of two.
LONGEST = 4096
#: The id behind every document.
END_ID = 2
#: Words whose ids a worker remembers before it keeps those of the texts in hand; only saves time.
REMEMBERED = 600_000
#: New words that the library encodes in one call, which takes about a kilobyte a word meanwhile.
LEARNED = 16_384
#: A sign that is a token of its own between spaces; parts words that are encoded together.
_PART = "\x1f"

#: The normalizer whose work on words of printable ASCII and Latin-1 letters is lower-casing alone.
_LOWERS = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
#: The pre-tokenizer that parts letters and digits from signs behind them, whatever comes before.
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of characters that are in composed form, no white space and whose small letters are one
#: character, the same in every Unicode version.
_SIMPLE = "^[!-~\u00a1-\u00ff]+$"
#: Those of these characters that are neither letters nor numbers.
_SIGNS = "".join(c for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x100))) if not c.isalnum())
#: Words of small letters alone among them.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans of these starts and sizes, one span behind the other."""
    # a batch has far fewer than 2**31 ids, and half the width saves memory
    at = np.repeat((starts - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return at


class WordTokenizer:
    """Ids of a tokenizer whose pre-tokenizer never crosses white space, remembered by word.

    A text is cut at ASCII white space, which such a tokenizer drops, and each distinct word is
    encoded once; words that are new are encoded together, parted by a sign. Words that hold the
    sign or a piece of a special token are encoded alone. Under the usual normalizer (``_LOWERS``)
    and pre-tokenizer (``_CUTS``) simple words are lower-cased first and the signs behind a word are
    words of their own, so all spellings of a word are encoded once. New words of letters alone then
    meet the same model parted by white space only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.part = np.uint32(self._alone(f"a {_PART} a")[1])
        self.known: dict[str, bytes] = {}
        steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        end = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.usual = bool(end) and [x and json.loads(x.__getstate__()) for x in steps] == [_LOWERS, _CUTS]
        if self.usual:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            ids = self.letters.get_vocab()
            #: Whether an id ends a word; words of letters hold no such ending themselves.
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for token, i in ids.items() if token.endswith(end)]] = True

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words that hold neither the sign nor a piece of a special token.

        All are words of small letters, or none is.
        """
        if self.usual and _LETTERS.fullmatch(words[0]):
            made = self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
            ids = np.array(made.ids, "<u4")
            cuts = 4 * np.flatnonzero(self.ends[ids]) + 4
            if len(cuts) == len(words):
                raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
                self.known.update(zip(words, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
                return
        ids = self._alone(f" {_PART} ".join(words))
        cuts = np.flatnonzero(ids == self.part)
        if len(cuts) != len(words) - 1:  # never seen; encodes them one by one
            for word in words:
                self.known[word] = self._alone(word).tobytes()
            return
        raw, start = ids.tobytes(), 0
        for word, cut in zip(words, [*(4 * cuts).tolist(), len(raw)]):
            self.known[word] = raw[start:cut]
            start = cut + 4

    def _remember(self, new: list[str]) -> None:
        """Add these distinct words to ``known``, which lacks them."""
        known = self.known
        every = " ".join(new)
        if "<|" in every or _PART in every:
            for word in new:
                if "<|" in word or _PART in word:
                    known[word] = self._alone(word).tobytes()
            new = [w for w in new if w not in known]
        letters = list(filter(_LETTERS.fullmatch, new))
        if letters:
            new = [w for w in new if not _LETTERS.fullmatch(w)]
        for words in (letters, new):
            for i in range(0, len(words), LEARNED):
                self._learn(words[i : i + LEARNED])

    def _stems(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Every word without the signs behind it, in small letters, and these signs.

        A word that isn't simple or holds a piece of a special token stays as it is.
        """
        if not self.usual:
            return words, pa.repeat(pa.scalar("", words.type), len(words))
        simple = pc.and_not(pc.match_substring_regex(words, _SIMPLE), pc.match_substring(words, "<|"))
        stems = pc.if_else(simple, pc.utf8_rtrim(pc.utf8_lower(words), _SIGNS), words)
        # lower-casing keeps the length of a simple word in bytes
        sizes = (pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 :][: len(words)]
        signs = np.frombuffer(words.buffers()[2] or b"", np.uint8)[_spans(ends - sizes, sizes)]
        cuts = pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))))
        return stems, pa.Array.from_buffers(words.type, len(words), [None, cuts, pa.py_buffer(signs)])

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every text.

        Words are cut and numbered by Arrow, and so are their stems and the signs behind them; only
        these become Python objects, and the ids of all texts are put together by place.
        """
        if not len(texts):
            return []
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        coded = lists.values.dictionary_encode()
        edges = lists.offsets.to_numpy()
        word = coded.indices.to_numpy()
        parts = pa.concat_arrays(self._stems(coded.dictionary.cast(pa.large_string()))).dictionary_encode()
        del lists, coded
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(entries) if ids is None]
        if new:  # the empty part, as behind a word without signs, has no ids
            self._remember([words[i] for i in new if words[i]])
            for i in new:
                entries[i] = self.known.get(words[i], b"")
        if len(self.known) > REMEMBERED:
            self.known = {w: ids for w, ids in zip(words, entries) if w}
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        ids = np.frombuffer(b"".join(entries), "<u4")
        part = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # a word's stem, then its signs
        ids = ids[_spans((np.cumsum(sizes) - sizes)[part], sizes[part])]
        sizes = sizes[part].reshape(-1, 2).sum(axis=1)
        starts, size = np.cumsum(sizes) - sizes, sizes[word]
        raw = ids[_spans(starts[word], size)].tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(size)))[edges]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, with the words it remembers.

    It outlives the task: loading the vocabulary and encoding the same words again in every task
    takes about a quarter of the time. ``REMEMBERED`` bounds it.
    """
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Whole longest pieces, then the binary digits of the rest, falling."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def token_pieces(
    documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
    longest: int = LONGEST, with_ids: bool = True,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` and, if asked for, the ``ids`` of every piece.

    A document is its text's ids and ``END_ID``; a null or empty text is that id alone. Its pieces
    have power-of-two lengths up to ``longest``, in falling order, and each id lies in exactly one.
    ``vocabulary`` names the tokenizer's file on the executors.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(keys: list, texts: pa.Array) -> pa.RecordBatch:
        rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
        for name, raw in zip(keys, word_tokenizer(vocabulary).encode(texts)):
            raw += END_ID.to_bytes(4, "little")
            at = 0
            for size in piece_lengths(len(raw) // 4, longest):
                piece = raw[4 * at : 4 * (at + size)]
                rows.append(name)
                starts.append(at)
                lengths.append(size)
                crcs.append(zlib.crc32(piece))
                totals.append(len(raw) // 4)
                if with_ids:
                    ids.append(np.frombuffer(piece, "<i4"))
                at += size
        made = [pa.array(rows, key_type), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
        names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            made, names = [*made, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(made, names)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(documents.schema[key].dataType)

    @task_scoped
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield cut(batch.column(0).to_pylist(), batch.column(1))

    return documents.select(key, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Give every piece a sequence of its own, numbered through the buckets of equal length.

    A sequence is one piece, so none crosses documents, every length is a power of two and nothing
    is padded; a batch of equal tokens takes 2**k sequences of one bucket. Sequences are numbered
    without gaps, the longest bucket first. Rows are numbered within hashed parts of each bucket and
    the parts' totals, one row each, give the offsets, so no bucket is gathered in one task.

    Returns the columns of ``pieces`` with the key's name and ``bucket``, ``sequence_id``,
    ``offset`` (0). Pieces equal in all columns are told apart by their number only.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.withColumn(
        "part", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(parts)).cast("int")
    )
    order = ["key", "start", "ids_crc32"]
    totals = spread.groupBy("length", "part").agg(F.count("*").alias("rows"))
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)))
    return placed.join(F.broadcast(offsets), ["length", "part"]).select(
        *[F.col(c).alias(key if c == "key" else c) for c in pieces.columns],
        F.col("length").alias("bucket"),
        (F.col("rows_before") + F.col("place") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def packed(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents as a digest of their packed pieces; tokenized once, kept without their ids."""
    return pack(durable(token_pieces(documents, vocabulary, key, text, with_ids=False)), key)
