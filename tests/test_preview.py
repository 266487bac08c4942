import pytest
from pyspark.sql import functions as F

from storelytics.functions.titles import clean_title, title_part
from storelytics.functions.urls import absolute_link, domain, normal_url, resolve_url, second_last_step
from storelytics.operators.preview import cascade as C
from storelytics.operators.preview import jobs as J
from storelytics.operators.preview import rules
from storelytics.operators.preview.scan import _Scan, elements
from storelytics.operators.preview.select import first, text


@pytest.fixture
def column(spark):
    def run(values, use):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in rows.orderBy("i").select(use(F.col("v"))).collect()]

    return run


@pytest.fixture
def pick(spark):
    """Value of one preview column for a page."""

    def run(html, what, url="https://www.shop.example.com/a/b.html"):
        page = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        return elements(page).select(what).first()[0]

    return run


def test_titles(column):
    assert column([" -- Red Shirt | Shop", "Red - Shop", "ab", "*a \n b*", "x-y", None], clean_title) == [
        "Red Shirt", "Red", "ab", "a b", "x-y", None]
    assert column(["A – Long part", "ab", "Red | Shop", "a|b-c—d", None], title_part) == ["Long part", "ab", "Shop", "a|b-c—d", None]


def test_normal_urls(column):
    cases = {
        "HTTP://Ex.COM": "http://ex.com/", "https://a.b:443/x/../y?q= 1#f": "https://a.b/y?q=%201#f",
        "http://a.b:8080/é": "http://a.b:8080/%C3%A9", "http:a.b/x": "http://a.b/x", "mailto:x@y": "mailto:x@y",
        "a.b/c": None, "//a.b": None, "": None, "https://": None, "http://u:p@H.com/": "http://u:p@h.com/", None: None,
    }
    assert column(list(cases), normal_url) == list(cases.values())


def test_resolving_links(column):
    base = F.lit("https://Shop.example.com/a/b/c.html?q=1#top")
    cases = {
        "https://x.com/y": "https://x.com/y", "//h/x": "https://h/x", "/x": "https://shop.example.com/x",
        "x": "https://shop.example.com/a/b/x", "../x": "https://shop.example.com/a/x",
        "../../../x/./y/": "https://shop.example.com/x/y/", "?z": "https://shop.example.com/a/b/c.html?z",
        "#f": "https://shop.example.com/a/b/c.html?q=1#f", "": "https://shop.example.com/a/b/c.html?q=1", None: None,
    }
    assert column(list(cases), lambda v: resolve_url(base, v)) == list(cases.values())
    assert column(["httpfoo.png", "foo.png"], lambda v: absolute_link(base, v)) == ["httpfoo.png", "https://shop.example.com/a/b/foo.png"]


def test_small_url_columns(column):
    assert column(["https://www.a.com/x", "https://m.www.a.com", "https://a.com:80"], domain) == ["a.com", "m.a.com", "a.com"]
    assert column(["https://a/b/77/buy", "plain", "a/b"], second_last_step) == ["77", "plain", "a"]


@pytest.mark.parametrize("selector", sorted(set(
    rules.TITLE_METAS + rules.TITLE_ELEMENTS + rules.GENERIC_TITLES + rules.DESCRIPTIONS + rules.IMAGES + rules.FAVICONS
    + [s for group in rules.SITE.values() for s in group])))
def test_selector_matches_what_it_says(selector):
    """Each rule's predicate names every word of the selector."""
    from storelytics.operators.preview.select import matches

    sql = matches(selector)
    for word in ("first-of-type", "last-child"):
        selector = selector.replace(word, word.replace("-", "_"))
    import re

    for word in re.findall(r"[A-Za-z_][\w-]*(?::\w+)?", selector.replace("class", "cls")):
        assert word.split(":")[-1] in sql, (word, sql)


PAGE = """<html><head><title> Page &amp; title </title><!-- <h1>no</h1> --></head><body>
<script>var x = "<h1>no</h1></p>";</script><p>one <b>two<p>three</p></p>
<div class="a product-Title b" id="main">Big <i>name</i></div>
<ul class="breadcrumb"><li>Home<li>Shoes</ul><span data-x>z</span><br/><img src=/a.png></body>"""


def test_scan():
    whole, found = _Scan().page(PAGE)
    text = [whole[e["start"]:e["until"]].decode() for e in found]
    tags = list(zip([e["tag"] for e in found], text))
    assert ("title", " Page & title ") in tags and not any(t == "h1" for t, _ in tags)
    # the second paragraph ends the first; the stray end tag makes an empty third one
    assert [t for t in tags if t[0] == "p"][:1] == [("p", "one two")] and ("p", "three") in tags and len([t for t in tags if t[0] == "p"]) == 3
    assert ("div", "Big name") in tags
    items = [(e, t) for e, t in zip(found, text) if e["tag"] == "li"]
    assert [(t, e["last_child"], e["first_of_type"]) for e, t in items] == [("Home", False, True), ("Shoes", True, False)]
    above = [e for e in found if e["pos"] < items[0][0]["pos"] <= e["last"]]
    assert [(e["tag"], e["id"], e["cls"]) for e in above] == [("ul", None, "breadcrumb")]


def test_scan_is_linear_in_the_page():
    """Ten times the depth or the elements give ten times the result: nothing is written once per level."""

    def size(html):
        whole, found = _Scan().page(html)
        assert found
        return len(whole) + sum(len(str(e)) for e in found)

    makers = [
        lambda n: '<div class="product name">word ' * n, lambda n: '<span id="product">w' * n + "</span>" * n,
        lambda n: '<ul class="breadcrumb"><li>Home' * n, lambda n: '<h1 class="product">a</h1></b></i>' * n, lambda n: "<p>" * n + "</q>" * n,
    ]
    for make in makers:
        assert size(make(10_000)) < 12 * size(make(1_000))


def test_texts_of_a_deep_and_wide_page(pick):
    """Bytes and characters differ; inner texts are parts of outer ones."""
    deep = '<div class="outer">\u00fc\u20ac<div class="inner">\U0001f600 x</div>z</div><h1>\u00e9nd\u00e9d</h1>'
    assert pick(deep, text(".outer")) == "\u00fc\u20ac\U0001f600 xz" and pick(deep, text(".inner")) == "\U0001f600 x"
    assert pick(deep, text("h1")) == "\u00e9nd\u00e9d" and pick(deep, text(".none")) is None and pick("<p></p>", text("p")) == ""
    assert pick(deep, text(".outer .inner")) == "\U0001f600 x" and pick(deep, text(".outer h1")) is None
    assert pick("&#xD800;<p>a&#0;b&#x110000;</p>", text("p")) == "a\ufffdb\ufffd"
    assert pick(None, text("p")) is None and pick("", text("p")) is None


def test_selectors_on_a_page(pick):
    assert pick(PAGE, text(".a")) == "Big name"
    assert pick(PAGE, first("#main")["tag"]) == "div"
    assert pick(PAGE, first(".product")) is None
    assert pick(PAGE, first('[class*="product"][class*="Title"]')["id"]) == "main"
    assert pick(PAGE, text(".breadcrumb li:last-child")) == "Shoes"
    assert pick(PAGE, first("span[data-x]")["tag"]) == "span"


def test_title_order(pick):
    data = '<script type="application/ld+json">{}</script>'
    product = data.format('{"@type":"Product","name":"J"}')
    cases = {
        data.format("oops") + data.format('{"@graph":[{"@type":"Offer","name":"no"},{"@type":"Product","name":"G"}]}') + '<meta property="og:title" content="M">': "G",
        product + '<meta property="og:title" content="M">': "J",
        data.format('{"@type":["Product"],"name":"no"}') + '<meta name="title" content=" M ">': "M",
        '<meta property="og:title" content=" "><meta name="twitter:title" content="T">': "T",
        '<h1 class="title">abc</h1><div id="my-product-name">  Red  Shirt | Shop </div>': "Red Shirt",
        "<h1> Long headline - x </h1>": "Long headline",
        "<h1>abc</h1><h1>Second one</h1><title>t</title>": "Second one",
        "<title>ab | Some shop</title>": "Some shop",
        "<title> ab </title>": "ab",
        '<div class="pdp_title">xy</div>': "xy",
        "<p>nothing</p>": None,
    }
    for html, want in cases.items():
        assert pick(html, C.title()) == want, html


def test_metas_fall_through_empty_values(pick):
    html = '<meta name="author" content=""><meta property="og:author" content="O"><meta name="twitter:author" content="T">'
    assert pick(html, C.author()) == "O"


def test_descriptions(pick):
    assert pick('<meta name="description" content="M"><meta property="og:description" content="O">', C.description()) == "O"
    assert pick('<p>first</p><div class="long-description"> D </div>', C.description()) == "D"
    assert pick("<div><p>a&lt;b</p><p>c</p></div>", C.description()) == "a<b"


def test_images(pick):
    url = F.col("url")
    assert pick('<div class="pdp-image"><img src="/logo.png"></div><img class="img-responsive" src="x.png">', C.image(url)) == "https://www.shop.example.com/a/x.png"
    assert pick('<img class="img-responsive" src="x.png" data-old-hires="raw.png">', C.image(url)) == "raw.png"
    assert pick('<meta property="og:image" content="my-icon.png"><img id="ProductPhotoImg" src="p.png">', C.image(url)) == "https://www.shop.example.com/a/p.png"
    sized = '<img src="s.png" width="100" height="900"><img src="logo.png" width="999" height="999"><img src="i-icon.png" width="300px" height="300"><img src="b.png" width="300" height="300">'
    assert pick(sized, C.image(url)).endswith("i-icon.png")
    assert pick('<img src="x.png" width="300" height="200">', C.image(url)) is None


def test_preview_keeps_failed_pages_with_blanks(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.a.com/x", None), (2, "nope", "<title>Long title</title>"), (3, "HTTPS://A.com", "<title>Long title</title><img src=i.png>")],
        "page_id long, url string, html string",
    )
    rows = {r.page_id: r for r in J.link_preview(pages).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1].product_link, rows[1].product_name, rows[1].domain, rows[1].image_link) == ("https://www.a.com/x", "", "", "")
    assert (rows[3].product_name, rows[3].image_link, rows[3].domain) == ("Long title", "https://a.com/i.png", "a.com")


def test_mail_providers(spark):
    rows = spark.createDataFrame([("A@HOTMAIL.com",), ("x@else.org",), ("nobody",), (None,), ("",)], "email string")
    good, bad = J.mail_provider(rows)
    assert [r.provider for r in good.collect()] == ["outlook", "gmail", "gmail"]
    assert bad.count() == 2


def test_noise(spark):
    rows = spark.createDataFrame([("x NET::err_failed",), ("track&REPORT",), ("fine",), (None,)], "text string")
    assert [r.text for r in J.drop_noise(rows).collect()] == ["fine", None]


def test_addresses_with_impossible_hosts_are_refused(frame):
    bad = ["http://a b/x", "http://a:port/", "http://a:99999/", "http://a%zz/", "http://", "http://a^b/", "http://a[b/"]
    good = ["http://a/", "http://u:p@a.b:8080/x", "http://[::1]:80/", "http://a%41/", "https://\u00fc.de/"]
    rows = frame("url string", *[(u,) for u in bad + good])
    got = [r[0] for r in rows.select(normal_url(F.col("url"))).collect()]
    assert got[: len(bad)] == [None] * len(bad) and None not in got[len(bad) :]


def test_site_rules_are_data(spark):
    """Selectors of every form, two sites in one call, ranks, defaults, pages without a site or a match."""
    from storelytics.operators.preview import sites

    html = '<div class="a b" id="top"><ul><li class="t">x</li><li class="t">y</li></ul><span data-k="v w" class="heading">Head</span></div><img src="p.png">'
    pages = spark.createDataFrame([
        (1, "https://www.one.example/", html), (2, "https://one.two.example/", html), (3, "https://three.example/", html),
        (4, "https://one.example/", "<div></div>"), (5, None, html), (6, "https://one.example/", None), (7, "https://two.example/", html),
    ], "page_id long, url string, html string")
    made = spark.createDataFrame([
        ("one", "title", 2, "#top span"), ("one", "title", 1, "li.t:last-child"), ("one", "title", 0, "h1.none"),
        ("ONE", "image", 0, "img[src]"), ("two", "title", 0, '.a.b [data-k*="v w"]'), ("two", "description", 0, "li:first-of-type"),
        ("two", "image", 0, 'img[src="other"]'),
    ], "site string, field string, rank int, selector string")
    got = {r.page_id: tuple(r)[1:] for r in sites.site_previews(pages, made).collect()}
    assert got == {
        1: ("one", "y", "No description available", "https://www.one.example/p.png"),
        2: ("one", "y", "No description available", "https://one.two.example/p.png"), 7: ("two", "Head", "x", None),
    }
    assert sites.site_previews(pages, made.limit(0)).count() == 0


def test_site_rules_agree_with_compiled_selectors(spark, tables):
    """The default retailer's rules as rows give what they give as code."""
    from storelytics.operators.preview import sites

    pages = tables.site_pages
    made = spark.createDataFrame(sites.site_rules(rules.SITE, "example"), "site string, field string, rank int, selector string")
    as_code = {r.page_id: (r.title, r.description, r.image) for r in C.site_preview(pages, "example").collect()}
    as_rows = {r.page_id: (r.title, r.description, r.image) for r in sites.site_previews(pages, made).collect()}
    assert as_rows == {k: v for k, v in as_code.items()} and as_rows


def test_every_page_of_a_known_site_has_a_record(spark):
    from storelytics.operators.preview import sites

    pages = spark.createDataFrame([
        (1, "https://one.example/x/11/buy", '<h1 class="t">Rule</h1>'), (2, "https://one.example/x/12/buy", ""), (3, "https://one.example/x/13/buy", "<h1>General</h1>"),
        (4, "https://one.example/x/14/buy", None), (5, "https://else.example/x/11/buy", "<h1>No</h1>"),
    ], "page_id long, url string, html string")
    made = spark.createDataFrame([("one", "title", 0, ".t")], "site string, field string, rank int, selector string")
    labels = spark.createDataFrame([("one", "One")], "site string, label string")
    body = '{"style":{"name":"Served","description":"d","media":{"photos":[{"secureSrc":"s.png"}]}}}'
    answers = spark.createDataFrame([("one", "12", body), ("one", "11", body), ("one", "13", "{}"), ("two", "14", body)], "site string, product_id string, body string")
    got = {r.page_id: tuple(r)[1:] for r in sites.retailer_preview(pages, made, labels, answers).collect()}
    assert got == {
        1: ("one", "Rule", "No description available", None, "rule"), 2: ("one", "Served", "d", "s.png", "service"),
        3: ("one", "General", None, None, "page"), 4: ("one", "One Product", "Product information temporarily unavailable", None, "none"),
    }


def test_index_finds_what_the_elements_themselves_give(spark):
    """Every built-in selector by hits and by walking the elements, on random pages of the words the rules know."""
    import random

    from storelytics.operators.preview import select as S

    draw = random.Random(5)
    words = ["product", "title", "name", "image", "description", "pdp-image", "breadcrumb", "img-responsive", "pdp-title", "productTitle", "x", "product__title"]
    metas = ["og:title", "title", "twitter:title", "description", "og:image", "author"]

    def tag():
        kind = draw.choice(["div", "h1", "p", "img", "meta", "span", "li", "ul", "link", "title", "/div", "/ul", "/span", "/h1"])
        given = ""
        if draw.random() < 0.6:
            given += f' class="{draw.choice([" ", "  ", "-"]).join(draw.sample(words, draw.randint(1, 3)))}"'
        if draw.random() < 0.3:
            given += f' id="{draw.choice(["product-title", "product-image", "ProductPhotoImg", "main", "product title", ""])}"'
        if draw.random() < 0.4:
            given += draw.choice([' data-zoom-image="z"', " data-main-image", ' rel="icon"', ' data-testid="my-description"', ' data-product-title=""'])
        if kind == "meta":
            given += f' {draw.choice(["name", "property"])}="{draw.choice(metas)}" content="c"'
        return f"<{kind}{'' if kind[0] == '/' else given}>t"

    pages = [(n, "https://a.example/", "".join(tag() for _ in range(draw.randint(0, 80)))) for n in range(60)]
    scanned = elements(spark.createDataFrame([*pages, (99, None, None)], "page_id long, url string, html string"))
    listed = sorted(set(S.SELECTORS))
    found = scanned.select(
        *[F.expr(S.first_sql(s))["pos"].alias(f"a{k}") for k, s in enumerate(listed)],
        *[F.expr(f"get({S.matches(s)}, 0)")["pos"].alias(f"b{k}") for k, s in enumerate(listed)],
    ).collect()
    for row in found:
        for k, selector in enumerate(listed):
            assert row[f"a{k}"] == row[f"b{k}"], selector
    reached = [s for k, s in enumerate(listed) if any(row[f"a{k}"] is not None for row in found)]
    assert len(reached) > 30, reached
