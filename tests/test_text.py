from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions import text

REPAIRS = {
    None: "",
    "": "",
    " \t\n ": "",
    "plain text": "plain text",
    "  two  blanks \n and lines ": "two blanks and lines",
    "café": "café",
    "cafÃ©": "café",
    # Damaged twice.
    "cafÃ\u0083Â©": "café",
    "itâ€™s": "it's",
    "â€œhiâ€\u009d": '"hi"',
    "aâ€“b": "a-b",
    # The quote rule takes the first two characters of the ellipsis.
    "waitâ€¦": 'wait"¦',
    # An emoji lies outside Latin-1, so nothing is decoded again.
    "\U0001f600 cafÃ©": "\U0001f600 cafÃ©",
    # A real Â goes as well.
    "Âge": "ge",
    "“so” it’s": '"so" it\'s',
    "‘left stays": "‘left stays",
    "hard\u00a0 blank\u2003em": "hard blank em",
    "\u00a0edge\u3000": "edge",
    "line\u2028end\u0085 é ": "line end é",
    "ctrl\x1cgap": "ctrl gap",
}


def test_repair_table(values_of):
    assert values_of(text.repair_encoding, list(REPAIRS)) == list(REPAIRS.values())


def test_ellipsis_option(value_of):
    assert value_of(lambda c: text.repair_encoding(c, True), "waitâ€¦") == "wait..."


def test_repair_undoes_damage(values_of):
    rng = random.Random(7)
    alphabet = "abc xyz éèüßñçó ΑΩж中文 한"
    originals = [
        " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 60))).split()) for _ in range(300)
    ]

    def damaged(s, times):
        for _ in range(times):
            s = s.encode("utf-8").decode("latin-1")
        return s

    # Damage always shows a hint for these lead bytes, but not for every script.
    hinted = [o for o in originals if not set(o) & set("ΑΩж中文한")]
    for times in (1, 2):
        assert values_of(text.repair_encoding, [damaged(o, times) for o in hinted]) == hinted


def test_repair_is_stable_on_kept_texts(spark, values_of):
    """Tokens skip a second repair, which holds if repair changes nothing a second time."""
    rng = random.Random(3)
    pieces = [d for d, _ in fv.DAMAGE_REPLACEMENTS] + list(fv.DAMAGE_HINTS) + [
        "Â", " ", " ", "’", "“", "abc", "é", "Ã©", "\x9d"
    ]
    samples = ["".join(rng.choices(pieces, k=rng.randint(1, 8))) for _ in range(2000)]
    once = values_of(text.repair_encoding, samples)
    twice = values_of(text.repair_encoding, once)
    garbled = values_of(text.is_garbled, once)
    kept = [(a, b) for a, b, bad in zip(once, twice, garbled) if not bad]
    assert len(kept) > 100
    assert all(a == b for a, b in kept)


def test_garbled(values_of):
    texts = ["", None, "fine", "pâté", "São", "�", "Ø", "ok é ü"]
    assert values_of(text.is_garbled, texts) == [True, True, False, True, True, True, True, False]


def test_mostly_english(values_of):
    texts = ["", None, "123 !", "hello", "über alles schön", "привет", "ab привет", "абв abcdefghi"]
    assert values_of(text.is_mostly_english, texts) == [
        False, False, False, True, True, False, False, True,
    ]
    share = values_of(text.ascii_letter_share, ["abc", "abcж", "жж", "1", "KKİ"])
    assert share == [1.0, 0.75, 0.0, None, 1.0]


def test_tokens(values_of):
    texts = [
        "I don't like it", "The CAMERA bump, camera-lip!", "ab abc 123 12", "", None,
        "naïve fiancée", "cafÃ© sturdy",
    ]
    assert values_of(text.tokens, texts) == [
        ["don"], ["camera", "bump", "camera", "lip"], ["abc", "123"], [], [],
        ["fianc"], ["caf", "sturdy"],
    ]


def test_own_stopwords(value_of):
    assert value_of(lambda c: text.tokens(c, ()), "the don") == ["the", "don"]
    assert value_of(lambda c: text.tokens(c, ("it's", "don")), "the don") == ["the"]


def test_ngrams(value_of):
    def grams(n):
        return lambda c: text.ngrams(F.filter(F.split(c, ","), lambda w: w != ""), n)

    assert value_of(grams(2), "") == []
    assert value_of(grams(2), "a") == []
    assert value_of(grams(2), "a,b,c") == ["a b", "b c"]
    assert value_of(grams(3), "a,b,c,d") == ["a b c", "b c d"]
    assert value_of(grams(1), "a,b") == ["a", "b"]
    assert value_of(grams(5), "a,b") == []


def test_themes(values_of, value_of):
    texts = ["great support", "slippery", "MagSafe charger", "nothing", "", None]
    assert values_of(text.themes, texts) == [
        ["buttons_cutouts"], ["fit_and_grip", "camera_screen"], ["magnet_strength"], [], [], [],
    ]
    words = lambda c: text.themes(c, whole_word=True)
    assert value_of(words, "great support") == []
    assert value_of(words, "the port is fine") == ["buttons_cutouts"]
    assert value_of(lambda c: text.themes(c, {"q": ("o'k", "a\\b")}), "x o'k") == ["q"]
    assert value_of(lambda c: text.themes(c, {}), "x") == []


def test_yes(values_of):
    texts = ["yes", " YES ", "no", "", None]
    assert values_of(text.is_yes, texts) == [True, True, False, False, False]
    untrimmed = values_of(lambda c: text.is_yes(c, False), texts)
    assert untrimmed == [True, False, False, False, False]


def test_fixed_value_counts():
    assert len(set(fv.STOPWORDS)) == 133
    assert len(fv.THEME_LEXICON) == 6
    assert len(fv.DAMAGE_REPLACEMENTS) == 11
