"""The word tokenizer: same ids as the library, and no word encoded twice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StructField

from marketlens.llm import packing
from marketlens.llm.queries import vocabulary
from marketlens.llm.tables import end_of_task, task_scoped

ODD = [
    None, "", " ", "  a  b ", "\x1f a\x1fb", "<|endoftext|> x<|y Z", "É é ÉCOLE İstanbul ΣΑΣ Σ a\u0085b a b ﬁ K Å",
    "école ́x", "don't I'LL 12 $$$,, x\ty\x0bz\x0c w\n", "\x1c\x1d a\x1eb \x00a \x7f b\x01C", "ab​c 中文 \U0001f642x",
    "ẞß µª º × ÷ ÿ Ÿ", "… “q” it’s IT’S",
]


def test_ids_are_the_librarys():
    signs = [chr(c) for c in range(0x600)]
    texts = ODD + [f"{c}x A{c} {c} {c.upper()}b" for c in signs]
    words = packing.WordTokenizer(vocabulary())
    made = words.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]  # all remembered
    assert words.encode([]) == [] and words.encode([None, ""]) == [b"", b""]


def test_spellings_of_a_word_are_encoded_once(monkeypatch):
    words, learned = packing.WordTokenizer(vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda lot: (learned.extend(lot), learn(lot)))
    words.encode(["Gaarue gaarue GAARUE", "gaarue Ciónuear ciónuear"])
    assert sorted(learned) == ["ciónuear", "gaarue"]


def test_a_word_is_encoded_once_whatever_signs_follow(monkeypatch):
    words, learned = packing.WordTokenizer(vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda lot: (learned.extend(lot), learn(lot)))
    words.encode(["gaarue, Gaarue. GAARUE!! gaarue", "ciónuear… (gaarue), w3, W3. <|gaarue|>", "Ciónuear» ciónuear,"])
    assert sorted(learned) == sorted(["gaarue", ",", ".", "!!", "ciónuear…", "(gaarue", "),", "w3", "ciónuear", "»"])
    assert "<|gaarue|>" in words.known and "" not in words.known


def test_signs_behind_words_keep_the_librarys_ids():
    signs = [*map(chr, range(0x21, 0x180)), "\u0301", "\u0307", "\u030a", "\u0338", "\u00ad", "…", "’", "<|endoftext|>"]
    texts = [
        " ".join(f"{a}{c}{b}" for a in ("W", "i", "É", "7", "²", "don't", "x»", "'", "") for b in ("", ",", "'s", "'", "×!", "I"))
        for c in signs
    ]
    words = packing.WordTokenizer(vocabulary())
    made = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]


def test_another_tokenizer_gets_whole_words(tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary())
    other.normalizer = None
    other.save(path := str(tmp_path / "other.json"))
    words, learned = packing.WordTokenizer(path), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda lot: (learned.extend(lot), learn(lot)))
    texts = ["gaarue, Gaarue. gaarue", "<|endoftext|>x, École"]
    made = other.encode_batch_fast(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]
    assert sorted(learned) == sorted(["gaarue,", "Gaarue.", "gaarue", "École"])


def test_the_workers_tokenizer_outlives_a_task():
    first = packing.word_tokenizer(vocabulary())
    first.encode(["gaarue"])
    end_of_task()
    assert packing.word_tokenizer(vocabulary()) is first and "gaarue" in first.known


def test_new_words_are_encoded_in_small_lots(monkeypatch):
    words, sizes = packing.WordTokenizer(vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda lot: (sizes.append(len(lot)), learn(lot)))
    texts = [" ".join(f"w{a}x{b}" for b in range(100)) for a in range(300)] + ["中1 中2"]
    made = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert words.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in made]
    assert sum(sizes) == 30_002 and max(sizes) <= 20_000


def test_words_in_hand_stay_when_too_many_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    words, learned = packing.WordTokenizer(vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda lot: (learned.extend(lot), learn(lot)))
    first = words.encode([f"w{a}" for a in range(20)])
    assert words.encode(["w3", "w4"]) == first[3:5]
    assert len(learned) == 20  # nothing was encoded twice
    words.encode([f"v{a}" for a in range(5)])
    assert set(words.known) == {"w3", "w4", *(f"v{a}" for a in range(5))}


def test_a_large_batch_is_tokenized_slice_by_slice(monkeypatch):
    """A session's batch of 10,000 rows never becomes Python objects at once."""

    class Frame:
        schema = {"doc_id": StructField("doc_id", LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    texts = [None, "", *("word " * 2_000 for _ in range(998)), "x " * 4_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    held, encode = [], packing.WordTokenizer.encode
    monkeypatch.setattr(
        packing.WordTokenizer, "encode",
        lambda self, part: (held.append((len(part), sum(len(str(t)) for t in part))), encode(self, part))[1],
    )
    made = list(packing.token_pieces(Frame(), vocabulary(), with_ids=False)(iter([batch])))
    assert all(rows == 1 or size < 9 << 20 for rows, size in held) and sum(rows for rows, _ in held) == 1001
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows) and {r["key"] for r in rows} == set(range(1001))
    assert sum(r["length"] for r in rows) == 2 * 1 + 998 * 2_001 + 4_000_001


def test_map_functions_get_bounded_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["é" * 50_000] * 300)], ["key", "text"])
    parts = []

    @task_scoped
    def run(batches):
        for part in batches:
            parts.append(part)
            yield part

    assert pa.Table.from_batches(run(iter([batch, batch.slice(0, 0)]))).equals(pa.Table.from_batches([batch]))
    assert len(parts) > 4 and all(p.nbytes <= 9 << 20 for p in parts)
