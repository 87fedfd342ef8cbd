"""Main text of web pages by composite text density over the element tree."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import map_columns

# How HTML treats its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the listed names, up to the nearest of ``SCOPE``.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
SCOPE = frozenset("ul ol dl table select body html".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend summary".split())
#: Elements that show no running text; nothing in them is kept.
TEXTLESS = frozenset(
    "button head iframe input label noscript object script select style svg template textarea".split()
)
#: Elements, roles and whole class or id names of what stands around an article.
AROUND = frozenset("aside dialog footer form header menu nav".split())
AROUND_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
AROUND_NAMES = re.compile(
    r"ads?|advert|adverts|advertisements?|advertising|adbox|ad[-_](?:banner|box|container|slot|unit|wrapper)|banner|breadcrumbs?|"
    r"comments?|commentlist|comments?[-_](?:area|form|list|section)|consent|cookies?|(?:cookie|consent)[-_](?:banner|bar|consent|"
    r"message|notice|popup)|disqus(?:[-_]thread)?|(?:(?:global|main|page|primary|secondary|site|top)[-_])?(?:footer|header|masthead|"
    r"menu|nav|navbar|navigation|sidebar)|login|menus|modal|newsletter(?:[-_](?:form|signup))?|notices?|notification|pager|"
    r"pagination|popup|promo|promos|promotions?|recommendations?|recommended|related(?:[-_](?:articles|content|links|news|posts|"
    r"stories))?|replies|reply|share|sharing|share[-_](?:bar|buttons|links)|signup|social|social[-_](?:bar|buttons|icons|links|media|"
    r"share)|sponsor|sponsors|sponsored|subscribe|toolbar|widgets?"
)
MAIN = frozenset(("article", "main"))
#: Elements that can be a whole text; of others the parent is taken.
HOLDERS = MAIN | frozenset(("div", "section", "td", "body", "#page"))
#: Share of a text from which a part counts as nearly all of it.
NEARLY_ALL = 0.9

_MARKUP = re.compile(
    r"<!--(?:.*?--|)>|<!--.*|<!\[CDATA\[.*?\]\]>|<[!?/][^a-zA-Z>][^>]*>|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|"
    r"<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Element:
    name: str
    parent: "Element | None"
    hidden: bool = False
    around: bool = False
    content: list = field(default_factory=list)  # texts and elements, in page order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


def _is_hidden(name: str, attributes: str) -> bool:
    """Whether nothing in the element is running text that the page shows."""
    if name in TEXTLESS:
        return True
    if not attributes or name in ("html", "body"):
        return False
    return any(
        key.lower() == "hidden" or key.lower() == "style" and re.search(r"display\s*:\s*none", value, re.I)
        for key, value in _NAMED.findall(attributes)
    )


def _is_around(name: str, attributes: str) -> bool:
    if name in AROUND:
        return True
    if not attributes or name in ("html", "body") or name in MAIN:
        return False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in AROUND_ROLES:
            return True
        if key in ("class", "id") and any(AROUND_NAMES.fullmatch(token) for token in value.split()):
            return True
    return False


def parsed(page: str) -> Element:
    """The element tree, with implied end tags, without hidden elements and what stands around articles."""
    root = Element("#page", None)
    open_, at, end_of_page = [root], 0, len(page)

    def text(until: int) -> None:
        if until > at and not open_[-1].hidden:
            open_[-1].content.append(html.unescape(page[at:until]))

    while at < end_of_page:
        m = _MARKUP.search(page, at)
        if m is None:
            text(end_of_page)
            break
        text(m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                open_[-1].hidden or open_[-1].content.append(m[0][9:-3])
            continue
        if m["end"] or m["end2"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    break
                if name == "p" and open_[i].name in BLOCK:  # no open paragraph here
                    break
            continue
        attributes = m["attributes"] or m["attributes2"] or ""
        if name in CLOSES_P:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == "p":
                    del open_[i:]
                    break
                if open_[i].name in BLOCK:
                    break
        if name in ENDS:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name in SCOPE:
                    break
                if open_[i].name in ENDS[name]:
                    del open_[i:]
                    # a row also ends the cells before it
                    if name in ("li", "dt", "dd", "option", "td", "th"):
                        break
        parent = open_[-1]
        element = Element(name, parent, parent.hidden or _is_hidden(name, attributes))
        if not element.hidden:
            element.around = _is_around(name, attributes)
            parent.content.append(element)
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not element.hidden:
                element.content.append(html.unescape(page[at : close.start() if close else end_of_page]))
            at = close.end() if close else end_of_page
            continue
        if not attributes.endswith("/") or name not in ("svg", "path"):
            open_.append(element)
    _drop_around(root)
    return root


def _drop_around(root: Element) -> None:
    """Takes marked elements out of the tree, those excepted that may hold the article themselves.

    These hold most of the page's text outside links, or, when only a name, a role or a form marks
    them, an article element with text; their inner elements are judged in turn. A header, footer,
    menu or aside doesn't stay on a page with an article element outside of marked ones, which may
    be shorter than its footer.
    """
    elements = _ordered(root)
    if not any(e.around for e in elements):
        return
    plain, holds = {}, set()
    for e in reversed(elements):
        size = plain.get(id(e), 0) + sum(len("".join(c.split())) for c in e.content if isinstance(c, str))
        plain[id(e)] = 0 if e.name == "a" else size
        if e.name in MAIN and plain[id(e)]:
            holds.add(id(e))
        if e.parent is not None:
            plain[id(e.parent)] = plain.get(id(e.parent), 0) + plain[id(e)]
            if id(e) in holds:
                holds.add(id(e.parent))
    half = plain[id(root)] / 2
    marked = set()
    for e in elements:
        if e.around or e.parent is not None and id(e.parent) in marked:
            marked.add(id(e))
    article = any(e.name in MAIN and id(e) in holds and id(e) not in marked for e in elements)

    def stays(e: Element) -> bool:
        if not e.around:
            return True
        if e.name in AROUND and e.name != "form":
            return plain[id(e)] > half and not article
        return plain[id(e)] > half or id(e) in holds

    todo = [root]
    while todo:
        e = todo.pop()
        e.content = [c for c in e.content if isinstance(c, str) or stays(c)]
        todo.extend(c for c in e.content if isinstance(c, Element))


def _ordered(root: Element) -> list[Element]:
    """Elements with every parent before its children."""
    found, i = [root], 0
    while i < len(found):
        found.extend(c for c in found[i].content if isinstance(c, Element))
        i += 1
    return found


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - link_chars) * link_chars + share * c + math.e)
    ratio = c / lc * t / lt
    return c / t * (math.log(ratio) / math.log(base + 1e-9) if ratio > 1 and base > 1 + 1e-9 else math.log(max(1.0, ratio)) + 1)


def measured(root: Element) -> list[Element]:
    """Composite text density and the sum of the children's for every element.

    Density is characters per tag times the logarithm of the characters and tags outside links
    over those inside, to a base that grows with the links in the element and in the whole page.
    """
    elements = _ordered(root)
    for e in reversed(elements):
        e.chars += sum(len("".join(c.split())) for c in e.content if isinstance(c, str))
        if e.name == "a":
            e.link_chars, e.link_tags = e.chars, e.tags
        if e.parent is not None:
            up = e.parent
            up.chars += e.chars
            up.tags += e.tags + 1
            up.link_chars += e.link_chars
            up.link_tags += e.link_tags + (e.name == "a")
    share = root.link_chars / max(1, root.chars)
    for e in elements:
        e.density = _density(e.chars, e.tags, e.link_chars, e.link_tags, share)
        if e.parent is not None:
            e.parent.density_sum += e.density
    return elements


def main_elements(elements: list[Element]) -> list[Element]:
    """The subtree with the largest density sum, among those not sparser than its path allows.

    The smallest density on the way from the first candidate up to the page is the threshold. An
    element without children can win by its own density. Names only round the choice off: articles
    inside the winner stand for it if they hold nearly all of its text, and an article around it
    does if it adds little or equally dense text. Other articles come with it, in page order, unless
    they are sparse and hold links, as teasers do.
    """
    root = elements[0]
    best = max(elements, key=lambda e: e.density_sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(e.density for e in path)
    dense = [e for e in elements if e.density >= threshold and e.chars]
    best = max(dense, key=lambda e: e.density_sum, default=root)
    # a single paragraph or line of a longer text: its parent holds the text
    while best.parent is not None and best.name not in HOLDERS:
        best = best.parent
    share = root.link_chars / max(1, root.chars)

    def alike(e: Element) -> bool:
        return e.chars > 0 and (not e.link_chars or e.density >= threshold / 2)

    if best.name not in MAIN:
        inner = [e for e in _outermost(best) if alike(e)]
        if inner and sum(e.chars for e in inner) >= NEARLY_ALL * best.chars:
            return inner
    stands, e = best, best.parent
    while e is not None:
        if e.name in MAIN:
            rest = _density(
                e.chars - stands.chars, e.tags - stands.tags, e.link_chars - stands.link_chars, e.link_tags - stands.link_tags, share
            )
            if stands.chars >= NEARLY_ALL * e.chars or rest >= threshold / 2:
                stands = e
        e = e.parent
    if stands.name != "article":
        return [stands]
    scope = stands.parent
    while scope.parent is not None and scope.name not in MAIN:
        scope = scope.parent
    return [e for e in _outermost(scope) if e is stands or e.name == "article" and alike(e)]


def _outermost(element: Element) -> list[Element]:
    """Article elements inside an element that lie in no other one there, in page order."""
    found, todo = [], [element]
    while todo:
        e = todo.pop()
        if e.name in MAIN and e is not element:
            found.append(e)
        else:
            todo.extend(c for c in reversed(e.content) if isinstance(c, Element))
    return found


def block_texts(element: Element) -> list[str]:
    """Texts of the blocks in page order, white space made single spaces; empty blocks left out."""
    blocks, current = [], []

    def close() -> None:
        line = " ".join("".join(current).split())
        current.clear()
        if line:
            blocks.append(line)

    todo: list = [element]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            current.append(part)
        else:
            if part.name == "br":
                current.append(" ")
            if part.name in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(part.content))
    close()
    return blocks


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages."""
    if not page:
        return ""
    return "\n".join(line for e in main_elements(measured(parsed(page))) for line in block_texts(e))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page, from the whole of its markup.

    Scripts and hidden elements count nowhere. Menus, headers, footers, sidebars, notices, adverts,
    forms and comments, marked by element, role and whole class or id names, don't either unless
    they may hold the article (see ``_drop_around``); text density then finds it. Null and empty
    pages have empty text; a page without any markup is its own text. Equal rows give equal rows.
    Other columns are not read. Pages are worked on one at a time, without a shuffle.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def extracted(keys, urls, bodies):
        return {"key": keys, "url": urls, "text": [main_text(b) for b in bodies]}

    found = map_columns(pages.select(key, url, page), f"key {kinds[0]}, url {kinds[1]}, text string", extracted)
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
