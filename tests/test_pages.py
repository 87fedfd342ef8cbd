from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketlens import fixed_values as fv
from marketlens.functions import markup
from marketlens.operators import pages
from marketlens.plans import page_harvest
from marketlens.sources import writers


def ids(n):
    return [f"B{i:09d}" for i in range(n)]


def attribute_page(values):
    return "<ul>" + "".join(f'<li class="x" data-asin="{v}">t</li>' for v in values) + "</ul>"


def link_page(links):
    return "".join(f"<a class='l' href='{x}'>t</a>" for x in links)


def test_visible_markup(value_of):
    page = '<a href="1">x</a><!-- <a href="2"> --><script>"<a href=3>"</script><STYLE>a</STYLE>y'
    assert value_of(markup.visible_markup, page) == '<a href="1">x</a>y'


def test_node_text(values_of):
    pieces = [
        " a <b> b </b>\n c ", "&nbsp; x&nbsp;y &nbsp;", "AT&amp;T &lt;b&gt; &quot;q&quot;",
        "&amp;lt;", "&#233;&#xE9;&#x1F600;&#0;&#99999999;", "<i></i>", "", None, "no & entity",
    ]
    assert values_of(markup.node_text, pieces) == [
        "abc", "x y", 'AT&T <b> "q"', "&lt;", "éé\U0001f600��", "", "", None, "no & entity",
    ]


@pytest.mark.parametrize(
    "page, start, inner",
    [
        ('<p><span id="t">A</span></p>', markup.open_tag("span", "t"), "A"),
        ("<p><SPAN class='x' ID=t>A</SPAN></p>", markup.open_tag("span", "t"), "A"),
        ('<span id="tt">A</span>', markup.open_tag("span", "t"), None),
        ('<div id="t">A</div>', markup.open_tag("span", "t"), None),
        ('<div id="t">A</div>', markup.open_tag(element_id="t"), "A"),
        ('<span id="t"></span>', markup.open_tag("span", "t"), ""),
        ('<b data-id="t">A</b><b id="t">B</b>', markup.open_tag("b", "t"), "B"),
        ('<i class="a b c">A</i>', markup.open_tag("i", classes=("b",)), "A"),
        ('<i class="ab bc">A</i>', markup.open_tag("i", classes=("b",)), None),
        ('<i class="c a b">A</i>', markup.open_tag(classes=("a", "b", "c")), "A"),
        ('<i class="c a">A</i>', markup.open_tag(classes=("a", "b", "c")), None),
        ('<i data-hook="h">A</i>', markup.open_tag("i", attributes={"data-hook": "h"}), "A"),
        # Elements of the same name inside, side by side and nested.
        (
            '<div id="t">1<div>2<div>3</div></div>4<DIV>5</DIV>6</div>7</div>',
            markup.open_tag("div", "t"),
            "1<div>2<div>3</div></div>4<DIV>5</div>6",
        ),
        ('<b id="t">1<br>2</b>3', markup.open_tag("b", "t"), "1<br>2"),
        ('<b id="t">1', markup.open_tag("b", "t"), "1"),
        ("plain", markup.open_tag("b", "t"), None),
        ("", markup.open_tag("b"), None),
    ],
)
def test_element_markup(value_of, page, start, inner):
    assert value_of(lambda c: markup.element_markup(c, start), page) == inner


def test_long_element(value_of):
    body = "<b>x</b>" * 20_000 + "y" * 200_000
    page = f'<div id="t">{body}<div>in</div></div>tail'
    start = markup.open_tag("div", "t")
    assert value_of(lambda c: markup.element_markup(c, start), page) == body + "<div>in</div>"


def test_links(value_of):
    page = (
        '<a href="/a?x=1&amp;y=2">1</a><A class=c HREF=\'/b\'>2</A><a name="n">3</a>'
        '<link href="/no"><abbr href="/no"></abbr><a data-href="/no" href="/c">4</a>'
        '<a href=/d class=x>5</a><a href="">6</a><a href="/e>f">7</a>'
    )
    assert value_of(markup.links, page) == ["/a?x=1&y=2", "/b", "/c", "/d", "", "/e>f"]


def test_ids_from_segments(value_of):
    page = link_page([
        "/dp/B0ABCDEFGH/ref", "/dp/B0ABCDEFGX?ref=1", "/gp/product/1234567890/", "/x/B0AAAAAAAA",
        "/dp/-123456789/B0ABCDEFGH", "/electronics/dp/B0ABCDEFG1/abcdefghij",
    ])
    got = value_of(lambda c: pages.ids_from_segments(markup.links(c)), page)
    assert got == ["B0ABCDEFGH", "1234567890", "B0ABCDEFG1", "abcdefghij"]


def test_ids_from_attribute(value_of):
    good = ids(3)
    page = attribute_page([good[0], "", "short9999", good[1], good[0], "undefined", good[2]])
    assert value_of(pages.ids_from_attribute, page) == good


def test_ids_fallback(value_of):
    few, many = ids(9), ids(10)

    def crawled(page):
        return pages.ids_with_fallback(page, minimum=fv.MIN_ATTRIBUTE_IDS, cap=fv.MAX_IDS_PER_PAGE)

    link = link_page(["/dp/B0ABCDEFGH?ref=1", "/dp/" + few[0], "/dp/tooshort"])
    assert value_of(crawled, attribute_page(few) + link) == few + ["B0ABCDEFGH"]
    assert value_of(crawled, attribute_page(many) + link) == many
    assert value_of(crawled, attribute_page(ids(40)) + link) == ids(30)
    assert value_of(crawled, "<p>none</p>") == []


def test_page_item_ids(spark):
    table = spark.createDataFrame(
        [("u1", attribute_page(ids(12))), ("u2", "Captcha " + attribute_page(ids(12))), ("u3", None),
         ("u4", attribute_page(ids(3)))],
        "url string, html string",
    )
    found = pages.page_item_ids(table, "attribute", skip_blocked=True)
    rows = [(r.url, r.position, r.ASIN) for r in found.orderBy("url", "position").collect()]
    assert rows == [("u1", i + 1, a) for i, a in enumerate(ids(12))] + [
        ("u4", i + 1, a) for i, a in enumerate(ids(3))
    ]
    assert found.first().detail_url == fv.DETAIL_URL_PREFIX + "B000000000"
    assert sorted(r.ASIN for r in pages.distinct_ids(found).collect()) == ids(12)
    with pytest.raises(ValueError):
        pages.page_item_ids(table, "guess")


ITEM = """<html><span id="productTitle"> Clear <b>Case</b> </span>
<span class="a-price"><span class="a-offscreen">$19.99</span><span class="a-price-whole">19<span>.</span>
</span><span class="a-price-fraction">99</span></span>
<span class="a-icon-alt">4.5 out of 5 stars</span><span id="acrCustomerReviewText">1,234 ratings</span>
<a id="bylineInfo">Brand: Acme</a>{rank}</html>"""
IN_SPAN = '<li><span>Best Sellers Rank</span> <span>#1,234 in <a>Cases</a></span></li>'
IN_CELL = "<table><tr><td>7</td></tr><tr class='r'><td><b>Best Sellers Rank</b></td><td>#56 in X</td></tr></table>"


def details(spark, *html):
    table = spark.createDataFrame([(f"i{i}", h) for i, h in enumerate(html)], "id string, html string")
    return [r.asDict() for r in pages.product_details(table, F.col("id")).orderBy("ASIN").collect()]


def test_product_details(spark):
    in_span, in_cell, bare, blocked, absent, dangling = details(
        spark, ITEM.format(rank=IN_SPAN), ITEM.format(rank=IN_CELL), "<p>x</p>",
        "<p>Type the CHARACTERS you see</p>", None, "<p></p><span>Best Sellers Rank</span> end",
    )
    assert in_span == {
        "ASIN": "i0", "Title": "ClearCase", "Price": "19.99", "Rating": "4.5 out of 5 stars",
        "Reviews": "1,234 ratings", "Brand": "Acme", "BSR": "1234", "Status": "Success",
    }
    assert in_cell["BSR"] == "56"
    assert bare == {
        "ASIN": "i2", "Title": "N/A", "Price": "N/A", "Rating": "0", "Reviews": "0",
        "Brand": "N/A", "BSR": "N/A", "Status": "Success",
    }
    for row in (blocked, absent):
        assert row["Status"] == "Failed to Fetch Detail"
        assert all(v is None for k, v in row.items() if k not in ("ASIN", "Status"))
    assert dangling["Status"] == "Parse Error" and dangling["BSR"] is None


def test_price_text(values_of):
    whole = '<span class="a-price-whole">5</span>'
    off = '<span class="a-offscreen"> $6.00 </span>'
    texts = [whole, whole + '<span class="a-price-fraction">49</span>' + off, off, "x"]
    assert values_of(lambda c: pages.price_text(markup.parsed(c)), texts) == ["5", "549", "$6.00", "N/A"]


def test_quick_details(spark):
    page = (
        '<div id="title"><div>Long</div> title</div><span id="price_inside_buybox"> </span>'
        '<i data-hook="average-star-rating"><span class="a-icon-alt">4.1</span></i>'
        '<span class="a-price a-text-price a-size-medium apexPriceToPay">'
        '<span class="a-offscreen">$8.00</span><span>$8.00</span></span>'
        '<span id="acrCustomerReviewText">9 ratings</span>'
        '<span data-hook="total-review-count">10 global ratings</span>'
    )
    table = spark.createDataFrame(
        [("a", page, 200), ("b", None, 503), ("c", "<p>", 200)], "id string, html string, code int"
    )
    got = pages.quick_details(table, F.col("id"), F.col("code")).orderBy("ASIN").collect()
    assert got[0].asDict() == {
        "ASIN": "a", "Title": "Longtitle", "Price": "$8.00$8.00", "Rating": "4.1",
        "Reviews": "10 global ratings", "URL": fv.DETAIL_URL_PREFIX + "a", "Error": None,
    }
    assert got[1].Error == "Status 503" and got[1].Title is None
    assert (got[2].Title, got[2].Price, got[2].Rating, got[2].Reviews) == ("N/A",) * 4
    fine = pages.without_errors(pages.quick_details(table, F.col("id"), F.col("code")))
    assert "Error" not in fine.columns and fine.count() == 2


def test_blocked_rate(spark):
    table = spark.createDataFrame([("a captCHA b",), ("ok",), (None,), ("fine",)], "html string")
    assert tuple(pages.blocked_rate(table).first()) == (4, 2, 0.5)
    assert tuple(pages.blocked_rate(table.limit(0)).first()) == (0, 0, 0.0)


def test_harvest(spark):
    wanted = ids(3)
    ranking = spark.createDataFrame(
        [("r1", attribute_page(wanted[:2])), ("r2", attribute_page(wanted))],
        "url string, html string",
    )
    url = fv.DETAIL_URL_PREFIX
    stored = spark.createDataFrame(
        [(url + wanted[0], ITEM.format(rank="")), (url + wanted[0], "captcha"),
         (url + wanted[1], "captcha"), (url + "B999999999", ITEM.format(rank=""))],
        "url string, html string",
    )
    got = {r.ASIN: r for r in page_harvest.harvest(ranking, stored).collect()}
    assert sorted(got) == wanted
    assert got[wanted[0]].Title == "ClearCase" and got[wanted[0]].Status == "Success"
    assert got[wanted[1]].Status == got[wanted[2]].Status == "Failed to Fetch Detail"
    assert page_harvest.failures(page_harvest.harvest(ranking, stored)).count() == 2


def test_union_ragged(spark):
    a = spark.createDataFrame([("1", "x")], "ASIN string, Title string")
    b = spark.createDataFrame([("2", "bad")], "ASIN string, Error string")
    rows = {tuple(r) for r in writers.union_ragged(a, b).collect()}
    assert rows == {("1", "x", None), ("2", None, "bad")}
    with pytest.raises(ValueError):
        writers.union_ragged()


def test_ids_are_whole_by_default(spark):
    many = "".join(f'<li data-asin="B{i:09d}"></li>' for i in range(45))
    page = f"<script>var captcha=1</script>{many}<a href=\"/dp/B999999999\">captcha</a>"
    table = spark.createDataFrame([("u", page)], "url string, html string")

    def ids(method, **options):
        return [r.ASIN for r in pages.page_item_ids(table, method, **options).orderBy("position").collect()]

    assert len(ids("attribute_then_links")) == 46
    assert len(ids("attribute_then_links", minimum=10, cap=30)) == 30
    assert len(ids("attribute")) == 45
    assert ids("links") == ids("segments") == ["B999999999"]
    for method in ("attribute_then_links", "attribute", "links", "segments"):
        assert ids(method, skip_blocked=True) == []


@pytest.mark.parametrize("depth", [0, 50, 51, 300])
def test_rank_in_a_deep_cell(value_of, depth):
    page = f"<table><tr><td>{'<b>' * depth}Best Sellers Rank{'</b>' * depth}</td><td>#77 in x</td></tr></table>"
    assert value_of(pages.rank_text, page) == "77"


def test_rank_behind_nested_elements(value_of):
    page = "<span>Best Sellers Rank</span><div><div>x</div>#5</div>"
    assert value_of(pages.rank_text, page) == "5"


@pytest.mark.parametrize(
    "text, want",
    [("&#00000000065;", "A"), ("&#x0000000041;", "A"), ("&eacute;&uuml;&ntilde;&szlig;", "éüñß"),
     ("&amp;lt; &lt;", "&lt; <"), ("&nosuch; &#99999999999;", "&nosuch; \ufffd")],
)
def test_references(value_of, text, want):
    from marketlens.functions import markup

    assert value_of(markup.unescape, text) == want


def test_every_named_reference_of_the_standard(spark):
    """Every name of the HTML 5 table, with and without ``;``, in four places, and numbers by rule."""
    import html
    from html.entities import html5

    from marketlens.functions import markup

    texts = [form.format(name) for name in html5 for form in ("a&{}b", "&{}", "&{} 2", "x&{}=1;")]
    texts += [
        "&dollar;12", "&comma;", "&lbrace;", "&copy 2", "&notit;", "&ampamp;", "&amp;lt; &lt;", "&&amp;", "a & b",
        "&#150;", "&#128;&#129;&#0;&#13;&#x7f;&#1;&#xD800;&#xFFFE;&#x10FFFF;&#x110000;", "&#65x", "&#x41", "&#",
        "&#x", "&", "&;", "&\u00e9;", "&" + "a" * 40 + ";", "&ltlt", "", "&#x1F600;&#128512;", "&a\tb", "&a\fb",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = frame.select("i", markup.unescape(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: html.unescape(t) for i, t in enumerate(texts)}


def test_every_paragraph_is_a_bullet(spark):
    import os
    import re

    from entry_queries.queries import _page_listings
    from entry_queries.roles import table
    from marketlens.functions import markup

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    stored = table(spark, sf_dir, "pages").select(markup.visible_markup(F.col("html")).alias("page")).collect()
    starts = sum(len(re.findall(r"(?i)<p[\s>]", r.page)) for r in stored)
    assert _page_listings(spark, sf_dir).agg(F.sum(F.size("bullets"))).first()[0] == starts


@pytest.mark.parametrize(
    "page, start, want",
    [
        ('<div><span id="productTitle" title="a>b">Name &amp; co</span></div>', ("span", "productTitle", ()), "Name & co"),
        ('<p><span class="x">open</p><p>other paragraph</p>', ("span", None, ("x",)), "open"),
        ('<span title="id=productTitle">no</span><span id=productTitle>yes</span>', ("span", "productTitle", ()), "yes"),
        ('<div class="a b"><div>in</div> <br> tail<img src=x></div>after', ("div", None, ("b",)), "intail"),
        ('<b id="t">x</i>y</b>z', ("b", "t", ()), "xy"),
        ('<ul><li id=k>one<li>two</ul>three', ("li", "k", ()), "onetwo"),
        ("<span id='k' data-x='1>2' class=z>in <i>side</span>out", ("span", "k", ()), "inside"),
        ('<span id="k"/>after', ("span", "k", ()), ""),
        ("nothing here", ("span", "k", ()), None),
        ("", ("span", "k", ()), None),
    ],
)
def test_elements_by_tokens(value_of, page, start, want):
    """Quoted values hide '>' and names; an element ends with its end tag or its parent's."""
    tag, element_id, classes = start
    rule = markup.open_tag(tag, element_id=element_id, classes=classes)
    got = value_of(lambda c: markup.tokens_text(markup.element_tokens(markup.parsed(c), rule)), page)
    assert got == want


def test_fields_on_varied_pages(spark):
    """Attribute order, quotes and unclosed elements do not change the detail fields."""
    shapes = [
        '<span class="a-size-large" id="productTitle"> Lamp </span><span class="a-price-whole">12</span>',
        "<span id=productTitle data-note='x>y'>Lamp</span><span class='a-price-whole'>12</span>",
        '<div><span id="productTitle">Lamp</div><span class="a-price-fraction">99</span>'
        '<span class="a-offscreen">$12.99</span>',
    ]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "item long, html string")
    rows = {r.ASIN: (r.Title, r.Price) for r in pages.product_details(frame, F.col("item")).collect()}
    assert rows == {0: ("Lamp", "12"), 1: ("Lamp", "12"), 2: ("Lamp", "$12.99")}
