"""Field extraction from HTML text as Column expressions.

The rules name an element by tag, id, class or attribute. A balanced search for the end
tag keeps nested elements of the same name whole. Nothing here builds a document tree:
an unclosed element runs to the end of the page, and a ``>`` inside a quoted attribute
ends the tag.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.binding import let, let_sql, quoted
from marketlens.functions.text import WHITESPACE, char_class

_SPACE = char_class(WHITESPACE)

# The named character references of HTML 5 are the standard library's copy of the public table,
# sorted for a binary search; numeric references are decoded by rule.
NAMED_REFERENCES: dict[str, str] = dict(sorted(html5.items()))
_STEPS = len(NAMED_REFERENCES).bit_length()


def _windows_1252(code: int) -> str:
    """What a numeric reference to a C1 control means: the Windows-1252 sign, where it has one."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def visible_markup(html: Column) -> Column:
    """The page without comments, scripts and style sheets, whose text holds no elements."""
    hidden = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
    return F.regexp_replace(html, hidden, "")


def _sql_unescape() -> str:
    """A SQL lambda that decodes references as the HTML 5 standard does, in one pass.

    The text is split at each ``&``; a piece that begins a reference is decoded and the rest of
    it kept. A name is looked up whole, then by its longest prefix of two or more characters in the
    table (so ``&copy 2`` and ``&notit;`` decode their known part); a piece that names nothing keeps
    its ``&``. Numbers follow the standard's rules for zero, C1 controls, surrogates, non-characters
    and values past U+10FFFF; the closing ``;`` is optional. Nothing decodes twice.
    """
    names = "array(" + ", ".join(map(quoted, NAMED_REFERENCES)) + ")"
    signs = "array(" + ", ".join(map(quoted, NAMED_REFERENCES.values())) + ")"
    c1 = "array(" + ", ".join(quoted(_windows_1252(c)) for c in range(128, 160)) + ")"
    # 1-based place of q among the sorted names, or 0
    place = (
        f"aggregate(sequence(1, {_STEPS}), named_struct('lo', 1L, 'hi', {len(NAMED_REFERENCES)}L), "
        "(b, j) -> CASE WHEN b.lo > b.hi THEN b ELSE get(transform(array((b.lo + b.hi) div 2), m -> "
        "CASE WHEN element_at(tab.n, cast(m AS INT)) = q THEN named_struct('lo', m, 'hi', -1L) "
        "WHEN element_at(tab.n, cast(m AS INT)) < q THEN named_struct('lo', m + 1, 'hi', b.hi) "
        "ELSE named_struct('lo', b.lo, 'hi', m - 1) END), 0) END, "
        "b -> CASE WHEN b.hi = -1 THEN cast(b.lo AS INT) ELSE 0 END)"
    )
    named = (
        "get(transform(array(regexp_extract(p, '^([^\\\\t\\\\n\\\\f <&#;]{1,32};?)', 1)), c -> "
        "CASE WHEN length(c) < 2 THEN concat('&', p) ELSE coalesce(get(transform(filter(transform("
        f"sequence(length(c), 2, -1), k -> named_struct('k', k, 'at', get(transform(array(substring(c, 1, k)), q -> {place}), 0))), "
        "x -> x.at > 0), x -> concat(element_at(tab.s, x.at), substring(p, x.k + 1))), 0), concat('&', p)) END), 0)"
    )
    character = (
        f"CASE WHEN code = 0 THEN {quoted(chr(0xFFFD))} WHEN code = 13 THEN {quoted(chr(13))} "
        f"WHEN code BETWEEN 128 AND 159 THEN element_at({c1}, cast(code - 127 AS INT)) "
        f"WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 THEN {quoted(chr(0xFFFD))} "
        "WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 "
        "OR code BETWEEN 64976 AND 65007 OR (code & 65534) = 65534 THEN '' "
        "ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END"
    )
    number = (
        "get(transform(array(named_struct('hex', p RLIKE '^#[xX]', "
        "'digits', regexp_extract(p, '^#[xX]?([0-9a-fA-F]+)', 1))), d -> get(transform(array(named_struct("
        "'value', CASE WHEN d.hex THEN regexp_extract(d.digits, '^0*([0-9a-fA-F]*)', 1) "
        "ELSE regexp_extract(d.digits, '^0*([0-9]*)', 1) END, "
        "'rest', substring(p, length(d.digits) + CASE WHEN d.hex THEN 3 ELSE 2 END))), v -> "
        "get(transform(array(CASE WHEN length(v.value) > 8 THEN 9999999999L WHEN v.value = '' THEN 0L "
        "WHEN d.hex THEN cast(conv(v.value, 16, 10) AS BIGINT) ELSE cast(v.value AS BIGINT) END), "
        f"code -> concat({character}, CASE WHEN v.rest LIKE ';%' THEN substring(v.rest, 2) ELSE v.rest END)), 0)), 0)), 0)"
    )
    # the names that pages hold most, closed by ";", need no search
    usual = " ".join(
        f"WHEN startswith(p, {quoted(n)}) THEN concat({quoted(html5[n])}, substring(p, {len(n) + 1}))"
        for n in ("amp;", "lt;", "gt;", "quot;", "nbsp;")
    )
    piece = (
        f"CASE {usual} "
        "WHEN p RLIKE '^#[0-9]' AND NOT p RLIKE '^#[xX]' THEN {n} "
        "WHEN p RLIKE '^#[xX][0-9a-fA-F]' THEN {n} ELSE {named} END"
    ).format(n=number, named=named)
    decoded = f"array_join(transform(split(t, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {piece} END), '')"
    table = f"named_struct('n', {names}, 's', {signs})"
    return f"t -> CASE WHEN contains(t, '&') THEN get(transform(array({table}), tab -> {decoded}), 0) ELSE t END"


_UNESCAPE = _sql_unescape()


def unescape(text: Column) -> Column:
    """Decode character references as the HTML 5 standard does; see ``_sql_unescape``."""
    return let_sql(text, _UNESCAPE)


_HARD_BLANK = quoted("&(?:nbsp|#160|#[xX][aA]0);")
_TAG_AND_SPACE = quoted(f"{_SPACE}*+<[^>]*>{_SPACE}*+")
_STRIP_NODES = (
    f"m -> btrim(regexp_replace(regexp_replace(m, {_HARD_BLANK}, {quoted(chr(0xA0))}), "
    f"{_TAG_AND_SPACE}, ''), {quoted(WHITESPACE)})"
)


def node_text(markup: Column) -> Column:
    """Text of a piece of markup: each text node stripped, then joined without a gap."""
    return unescape(let_sql(markup, _STRIP_NODES))


def joined_text(markup: Column) -> Column:
    """Text of a piece of markup with the white space of its nodes kept."""
    return unescape(F.regexp_replace(markup, "<[^>]*>", ""))


def _value_pattern(value: str, token: bool) -> str:
    # Attribute value after the equals sign: whole value, or one of its blank-separated words.
    v = re.escape(value)
    if token:
        return (
            rf"(?:\"(?:[^\">]*\s)?{v}(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?{v}(?:\s[^'>]*)?'|{v}(?=[\s>]))"
        )
    return rf"(?:\"{v}\"|'{v}'|{v}(?=[\s>]))"


@dataclass(frozen=True)
class StartTag:
    """A start tag to look for: a regex whose group 1 is the tag name, and texts that the
    page must contain for the regex to be worth trying. ``token`` matches one whole start tag
    of ``tag_tokens``, attribute by attribute, so that quoted values hide what they hold."""

    pattern: str
    needles: tuple[str, ...] = ()
    token: str = ""


def open_tag(
    tag: str | None = None,
    element_id: str | None = None,
    classes: Sequence[str] = (),
    attributes: dict[str, str] | None = None,
) -> StartTag:
    """The start tag with these properties.

    Attributes may stand in any order; every class in ``classes`` must be present.
    """
    name = re.escape(tag) if tag else "[a-zA-Z][a-zA-Z0-9]*"
    exact = dict(attributes or {})
    if element_id is not None:
        exact["id"] = element_id
    wanted = [
        rf"(?=[^>]*?\s(?i:{re.escape(key)})\s*=\s*{_value_pattern(value, False)})"
        for key, value in exact.items()
    ] + [rf"(?=[^>]*?\s(?i:class)\s*=\s*{_value_pattern(one, True)})" for one in classes]
    # whole attributes are skipped, so a name or value inside another quoted value never counts
    skip = r"""(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*?[\s/]+"""
    in_token = [
        rf"(?={skip}(?i:{re.escape(key)})\s*=\s*{_token_value(value, False)})" for key, value in exact.items()
    ] + [rf"(?={skip}(?i:class)\s*=\s*{_token_value(one, True)})" for one in classes]
    return StartTag(
        rf"<((?i:{name}))\b{''.join(wanted)}[^>]*>", (*exact.values(), *classes),
        rf"^<(?i:{name})(?=[\s/>]){''.join(in_token)}",
    )


def _token_value(value: str, token: bool) -> str:
    v = re.escape(value)
    if token:
        return rf"""(?:"(?:[^"]*\s)?{v}(?:\s[^"]*)?"|'(?:[^']*\s)?{v}(?:\s[^']*)?'|{v}(?=[\s/>]))"""
    return rf"""(?:"{v}"|'{v}'|{v}(?=[\s/>]))"""


# Elements without content or end tag (the void elements of HTML and the older
# ones that parsers treat alike); such a start tag never opens an element.
VOID_ELEMENTS = (
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer"
).split()

# A start tag read attribute by attribute (a quoted value may hold ">"), an end tag, another
# markup declaration, a run of text, or a "<" that starts none of these.
_TOKEN = (
    r"""<[a-zA-Z][^\s/>]*+(?:[\s/]++(?:[^\s/>=][^\s/>=]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?)?)*+>"""
    r"|</[a-zA-Z][^>]*+>|<[!?/][^>]*+>|[^<]++|<"
)


def tag_tokens(page: Column) -> Column:
    """The page as tokens in order: start tags, end tags, declarations and runs of text."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(_TOKEN), F.lit(0))


_VOIDS = ", ".join(map(quoted, VOID_ELEMENTS))
# The tags that open or end an element: place among the tokens, lower-case name, end tag or not.
# Byte tests come first, so a name is looked for once per tag and never in text.
_TAGS = (
    "filter(transform(tk, (x, i) -> named_struct('i', i + 1, 'end', startswith(x, '</'), "
    f"'n', CASE WHEN startswith(x, '<') THEN lower(regexp_extract(x, {quoted(r'^</?([a-zA-Z][^\s/>]*)')}, 1)) ELSE '' END, "
    f"'closed', endswith(x, '/>'))), y -> y.n <> '' AND (y.end OR NOT (y.closed OR y.n IN ({_VOIDS}))))"
)
# For every start tag that opens an element (``s``), the index of the token that ends it (``e``):
# its own end tag, or an end tag that closes an element around it. An end tag closes the latest open
# element of its name and every element opened after that one; an end tag with no open element of
# its name is passed over. Elements open at the end of the page end after the last token. The open
# elements' names and places (``names``, ``open``) stand latest first.
_NO_INDEX, _NO_NAME = "filter(array(0), z -> false)", "filter(array(''), z -> false)"
_ENDS = (
    f"aggregate({_TAGS}, named_struct('names', {_NO_NAME}, 'open', {_NO_INDEX}, 's', {_NO_INDEX}, 'e', {_NO_INDEX}), "
    "(st, y) -> CASE WHEN NOT y.end THEN named_struct('names', concat(array(y.n), st.names), "
    "'open', concat(array(y.i), st.open), 's', st.s, 'e', st.e) "
    "ELSE get(transform(array(cast(array_position(st.names, y.n) AS INT)), back -> CASE WHEN back = 0 THEN st "
    "ELSE named_struct('names', slice(st.names, back + 1, size(st.names)), 'open', slice(st.open, back + 1, size(st.open)), "
    "'s', concat(st.s, slice(st.open, 1, back)), 'e', concat(st.e, array_repeat(y.i, back))) END), 0) END, "
    "st -> named_struct('s', concat(st.s, st.open), 'e', concat(st.e, array_repeat(size(tk) + 1, size(st.open)))))"
)


def parsed(page: Column) -> Column:
    """``struct(tokens, ends)`` of a page, made once and read by every rule."""
    return let_sql(tag_tokens(page), f"tk -> named_struct('tokens', tk, 'ends', {_ENDS})")


def element_tokens(tree: Column, start_tag: StartTag) -> Column:
    """Tokens inside the first element whose start tag ``start_tag`` matches, or null.

    A byte search for the tag's values goes before the regex, and the place is found once.
    """
    tokens, ends = tree["tokens"], tree["ends"]

    def matches(x: Column) -> Column:
        possible = F.startswith(x, F.lit("<"))
        for needle in start_tag.needles:
            possible = possible & F.contains(x, F.lit(needle))
        return possible & x.rlike(start_tag.token)

    def inside(at: Column) -> Column:
        # a start tag that opens nothing (void or self-closed) holds nothing
        end = F.coalesce(F.get(ends["e"], (F.array_position(ends["s"], at) - 1).cast("int")), at + 1)
        return F.when(at > 0, F.slice(tokens, at + 1, end - at - 1))

    return let(F.array_position(F.transform(tokens, matches), True).cast("int"), inside)


def tokens_text(inner: Column) -> Column:
    """Text of tokens: each text node stripped, then joined without a gap, as ``node_text``."""
    texts = F.filter(inner, lambda x: ~x.startswith("<") | (x == "<"))
    stripped = F.transform(texts, lambda x: let_sql(x, _STRIP_NODES))
    return unescape(F.array_join(F.filter(stripped, lambda x: x != ""), ""))


def element_markup(page: Column, start_tag: StartTag) -> Column:
    """Inner markup of the first element that ``start_tag`` finds, or null.

    Most elements hold no element of their own name, and then the text up to the first
    end tag is the answer, found in one pass. Only the others take the second branch,
    which adds up the pieces between end tags until start and end tags balance. A byte
    search for the tag's values settles most absent elements without a regex.
    """
    pattern = start_tag.pattern
    first_end = quoted(rf"{pattern}((?s:.*?))(?:</(?i:\1)\s*>|\z)")
    to_page_end = quoted(rf"{pattern}((?s:.*))")
    start = quoted(pattern)
    same_start = rf"concat('(?i)<', tag, {quoted(r'(?=[\s>/])')})"
    same_end = rf"concat('(?i)</', tag, {quoted(r'\s*>')})"
    balanced = (
        f"reduce(split(regexp_extract(p, {to_page_end}, 2), {same_end}), "
        "named_struct('depth', 1, 'pieces', 0), "
        "(s, piece) -> CASE WHEN s.depth <= 0 THEN s ELSE named_struct("
        f"'depth', cast(s.depth + regexp_count(piece, {same_start}) - 1 AS INT), "
        "'pieces', s.pieces + 1) END).pieces"
    )
    # so many pieces between end tags make the element; they are put together once
    balanced = (
        f"get(transform(array({balanced}), k -> array_join(slice(split("
        f"regexp_extract(p, {to_page_end}, 2), {same_end}), 1, k), concat('</', tag, '>'))), 0)"
    )
    or_balanced = f"tag -> CASE WHEN regexp_count(m, {same_start}) > 0 THEN {balanced} ELSE m END"
    found = (
        f"get(transform(array(regexp_extract(p, {first_end}, 2)), m -> CASE "
        f"WHEN m = '' AND NOT p RLIKE {start} THEN NULL WHEN NOT contains(m, '<') THEN m "
        f"ELSE get(transform(array(lower(regexp_extract(p, {start}, 1))), {or_balanced}), 0) "
        "END), 0)"
    )
    possible = " AND ".join(f"contains(p, {quoted(n)})" for n in start_tag.needles) or "true"
    return let_sql(page, f"p -> CASE WHEN {possible} THEN {found} END")


# An attribute value as it stands in the page, with its quotes if it has any.
_RAW_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
_UNQUOTE = """v -> CASE WHEN v RLIKE '^["\\']' THEN substring(v, 2, length(v) - 2) ELSE v END"""


def _all_values(page: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(page, F.lit(pattern), F.lit(1))
    bare = F.call_function("transform", found, F.expr(_UNQUOTE))
    return F.call_function("transform", bare, F.expr(_UNESCAPE))


def links(page: Column) -> Column:
    """Every ``href`` of an ``a`` element, in page order."""
    return _all_values(page, rf"<(?i:a)\s(?:[^>]*?\s)?(?i:href)\s*=\s*{_RAW_VALUE}")


def attribute_values(page: Column, attribute: str) -> Column:
    """Every value of ``attribute`` on any element, in page order."""
    name = re.escape(attribute)
    return _all_values(page, rf"<[a-zA-Z](?:[^>]*?\s)(?i:{name})\s*=\s*{_RAW_VALUE}")
