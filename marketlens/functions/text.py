"""Text functions as Column expressions: repair, filters, tokens, themes.

All of them stay inside the JVM. Python's notion of white space is wider than both
``trim`` (blank only) and Java's ``\\s`` (ASCII only), so it is spelled out here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions.binding import let, let_sql, quoted

# Every code point that Python's str.isspace() accepts; none lies above U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def char_class(chars: str) -> str:
    """A regex character class that holds exactly ``chars``, neighbours joined to ranges."""
    codes = sorted({ord(c) for c in chars})
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(
        f"\\x{{{lo:x}}}" + (f"-\\x{{{hi:x}}}" if hi > lo else "") for lo, hi in ranges
    ) + "]"


def _runs_to_collapse(space: str) -> str:
    # A run that is not already one single blank; single blanks are left untouched. The
    # look-ahead rules out visible ASCII with one comparison before any class is tried.
    other, any_space = char_class(space.replace(" ", "")), char_class(space)
    return f"(?![!-~])(?:{other}{any_space}*+| {any_space}++)"


_ANY_RUN = _runs_to_collapse(WHITESPACE)
_ASCII_RUN = _runs_to_collapse("".join(c for c in WHITESPACE if ord(c) < 128))
# A text without any of these needs no repair.
_TOUCHED = tuple(
    dict.fromkeys(
        (*fv.DAMAGE_HINTS, *(d[0] for d, _ in fv.DAMAGE_REPLACEMENTS), *fv.PLAIN_QUOTES)
    )
)


def field(df: DataFrame, name: str, default: str = "") -> Column:
    """Column ``name`` as text, or ``default`` where it is null or absent."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(df[name].cast("string"), F.lit(default))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def collapse_whitespace(text: Column) -> Column:
    """Turn each run of white space into one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, _ANY_RUN, " "))


def _sql_has_any(name: str, needles: Sequence[str]) -> str:
    # A byte search per needle is faster than a regex class of many characters.
    return "(" + " OR ".join(f"contains({name}, {quoted(n)})" for n in needles) + ")"


_OUTSIDE_LATIN1 = r"[^\x00-\xff]"
# One more decoding where it succeeds. encode() fails the job on a character outside
# Latin-1, hence the guard.
_REDECODE = (
    f"p -> CASE WHEN p RLIKE {quoted(_OUTSIDE_LATIN1)} THEN p ELSE "
    "coalesce(try_validate_utf8(cast(encode(p, 'ISO-8859-1') AS STRING)), p) END"
)


def _sql_undo_damage(name: str, ellipsis_first: bool) -> str:
    rules = list(fv.DAMAGE_REPLACEMENTS)
    if ellipsis_first:
        rules.sort(key=lambda rule: rule[1] != "...")
    out = (
        f"CASE WHEN {_sql_has_any(name, fv.DAMAGE_HINTS)} "
        f"THEN get(transform(transform(array({name}), {_REDECODE}), {_REDECODE}), 0) "
        f"ELSE {name} END"
    )
    for damage, plain in (*rules, *fv.PLAIN_QUOTES.items()):
        out = f"replace({out}, {quoted(damage)}, {quoted(plain)})"
    return out


def repair_encoding(text: Column, ellipsis_first: bool = False) -> Column:
    """Undo UTF-8 text that was read as a one-byte encoding, then tidy it.

    Null and blank give the empty string. A text with a damage hint is decoded again at
    most twice; the literal table then catches what decoding cannot. ``ellipsis_first``
    lets the ellipsis rule act before the shorter quote rule that shadows it. ASCII text,
    the most common kind, only has its white space collapsed.
    """
    touched = (
        f"s -> CASE WHEN {_sql_has_any('s', _TOUCHED)} "
        f"THEN {_sql_undo_damage('s', ellipsis_first)} ELSE s END"
    )
    stripped = f"array(btrim(raw, {quoted(WHITESPACE)}))"
    return let_sql(
        F.coalesce(text.cast("string"), F.lit("")),
        "raw -> trim(CASE WHEN octet_length(raw) = length(raw) "
        f"THEN regexp_replace(raw, {quoted(_ASCII_RUN)}, ' ') ELSE regexp_replace("
        f"get(transform({stripped}, {touched}), 0), {quoted(_ANY_RUN)}, ' ') END)",
    )


def is_garbled(text: Column, markers: str = fv.GARBLED_MARKERS) -> Column:
    """True for an empty text or one that still holds a damage marker."""
    return let_sql(
        F.coalesce(text, F.lit("")), f"t -> t = '' OR {_sql_has_any('t', markers)}"
    )


def ascii_letter_share(text: Column) -> Column:
    """ASCII letters as a share of all letters; null where there are no letters.

    A text of one-byte characters needs no counting: its share is 1 if it has a letter.
    The Kelvin sign and dotted capital I have ASCII lower-case forms, so they count.
    """

    def share(t: Column) -> Column:
        return F.when(_is_ascii(t), F.when(t.rlike("[A-Za-z]"), F.lit(1.0))).otherwise(
            let(F.regexp_replace(t, r"[\x00-\x7f]++", ""), lambda rest: counted(t, rest))
        )

    def counted(t: Column, rest: Column) -> Column:
        plain = F.length(t) - F.length(F.regexp_replace(t, "[A-Za-z]++", ""))
        others = F.length(F.regexp_replace(rest, r"\P{L}++", ""))
        with_ascii_lower = F.length(F.regexp_replace(rest, r"[^\x{212a}\x{130}]++", ""))
        return F.try_divide(plain + with_ascii_lower, plain + others)

    return let(text, share)


def is_mostly_english(text: Column, threshold: float = fv.LETTER_SHARE_THRESHOLD) -> Column:
    """True where ASCII letters reach ``threshold``; a text without letters is not."""
    return F.coalesce(ascii_letter_share(text) >= F.lit(threshold), F.lit(False))


def tokens_of_repaired(text: Column, stopwords: Sequence[str] = fv.STOPWORDS) -> Column:
    """Lower-case runs of ``a-z0-9`` longer than two, without stopwords.

    For text that already went through ``repair_encoding`` and the garbled test, where a
    second repair changes nothing.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    words = F.coalesce(words, F.array().cast("array<string>"))
    # Shorter stopwords cannot meet a token; IN over many literals is a hash lookup.
    stop = sorted({w for w in stopwords if len(w) > 2})
    if not stop:
        return words
    not_stop = F.expr(f"w -> w NOT IN ({', '.join(map(quoted, stop))})")
    return F.call_function("filter", words, not_stop)


def tokens(text: Column, stopwords: Sequence[str] = fv.STOPWORDS) -> Column:
    """Tokens of a raw text: repair first, then ``tokens_of_repaired``."""
    return tokens_of_repaired(repair_encoding(text), stopwords)


def ngrams(words: Column, n: int = 2) -> Column:
    """Adjacent n-grams, joined by a blank; fewer than ``n`` words give none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    how_many = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), how_many)
    for shift in range(1, n):
        grams = F.zip_with(
            grams,
            F.slice(words, F.lit(1 + shift), how_many),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
    return grams


def _without_covered(keywords: Sequence[str]) -> list[str]:
    # A keyword that contains another one of the same label cannot add a hit.
    unique = list(dict.fromkeys(keywords))
    return [k for k in unique if not any(o != k and o in k for o in unique)]


def themes_of_repaired(
    text: Column,
    lexicon: Mapping[str, Sequence[str]] = fv.THEME_LEXICON,
    whole_word: bool = False,
) -> Column:
    """Labels whose keywords occur in the lower-cased text, each at most once.

    Keywords match inside words, so ``port`` finds ``support``; ``whole_word`` asks for
    word borders instead.
    """
    cases = []
    for label, keywords in lexicon.items():
        if not keywords:
            continue
        if whole_word:
            either = "|".join(r"\Q" + k + r"\E" for k in keywords)
            hit = f"t RLIKE {quoted(rf'\b(?:{either})\b')}"
        else:
            hit = _sql_has_any("t", _without_covered(keywords))
        cases.append(f"CASE WHEN {hit} THEN {quoted(label)} END")
    if not cases:
        return F.array().cast("array<string>")
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return let_sql(lowered, f"t -> array_compact(array({', '.join(cases)}))")


def themes(
    text: Column,
    lexicon: Mapping[str, Sequence[str]] = fv.THEME_LEXICON,
    whole_word: bool = False,
) -> Column:
    """Labels of a raw text: repair first, then ``themes_of_repaired``."""
    return themes_of_repaired(repair_encoding(text), lexicon, whole_word)


def join_title(title: Column, text: Column) -> Column:
    """Repaired title and text with one blank between, trimmed."""
    return F.trim(F.concat_ws(" ", title, text))


def is_yes(text: Column, trimmed: bool = True) -> Column:
    """True where the text is ``yes`` in any case; null counts as no."""
    value = strip(text) if trimmed else text
    return F.coalesce(F.lower(value) == "yes", F.lit(False))
