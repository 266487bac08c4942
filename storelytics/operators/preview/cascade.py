"""Picking title, description, image, icon and author of a page from its columns ``elements`` and ``page_text``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.titles import clean_title, title_part, trim, trim_sql
from storelytics.functions.urls import absolute_link, domain, resolve_url
from storelytics.operators.preview import rules
from storelytics.operators.preview.scan import elements
from storelytics.operators.preview.select import META_FORMS, attr, attr_sql, filled, first, first_sql, pick, text, text_of, text_sql

LINKED_DATA = "`@type` string, name string, `@graph` array<struct<`@type`:string, name:string>>"


def meta(name: str) -> Column:
    """Meta content by plain name, then Open Graph, then Twitter name."""
    return F.coalesce(*[attr(form.format(name), "content") for form in META_FORMS])


def linked_name() -> Column:
    """Product name from linked data: a Product at the root, else the first product of a graph.

    A script that is not valid JSON, or names no product, is passed over.
    """
    scripts = F.filter(
        "elements", lambda e: (e["tag"] == "script") & (F.element_at(e["attrs"], "type") == "application/ld+json")
    )

    def name(script):
        data = F.from_json(text_of(script), LINKED_DATA)
        in_graph = F.filter(data["@graph"], lambda item: item["@type"].isin("Product", "IndividualProduct"))
        root = F.when(data["@type"] == "Product", filled(data["name"]))
        return F.coalesce(root, filled(F.get(in_graph, F.lit(0))["name"]))

    return F.get(F.filter(F.transform(scripts, name), lambda n: n.isNotNull()), F.lit(0))


def _content(selectors: list[str]) -> Column:
    """Content, value or text of the first selector that yields any."""
    values = [attr_sql("content"), attr_sql("value"), text_sql()]
    return filled(trim(F.coalesce(*[pick(s, values) for s in selectors])))


def page_title() -> Column:
    return filled(trim(F.regexp_replace(text("title"), "[\\t\\n\\f\\r ]+", " ")))


def title() -> Column:
    """Product title: linked data, metas, product elements, any headline, page title, generic elements."""
    metas = [pick(s, [trim_sql(attr_sql("content"))]) for s in rules.TITLE_METAS]
    long = "length(t) > 3"
    shown = F.coalesce(*[pick(s, [trim_sql(text_sql())], long) for s in rules.TITLE_ELEMENTS])
    headlines = F.expr(f"transform(filter(elements, e -> e.tag = 'h1'), e -> {trim_sql(text_sql())})")
    headline = F.get(F.filter(headlines, lambda t: F.length(t) > 3), F.lit(0))
    # An element whose text cleans to nothing still ends the search for better product titles.
    product = filled(F.coalesce(clean_title(shown), headline, title_part(page_title())))
    return F.coalesce(linked_name(), *metas, product, _content(rules.GENERIC_TITLES), page_title())


def description() -> Column:
    """Description by rule, then by meta name, then the first paragraph."""
    return F.coalesce(_content(rules.DESCRIPTIONS), meta("description"), text("p"))


def _side(name: str, node: str) -> str:
    return f"try_cast(regexp_extract({attr_sql(name, node)}, r'^ *([0-9]+)', 1) AS BIGINT)"


def _area(node: str) -> str:
    return f"{_side('width', node)} * {_side('height', node)}"


def _by_rule() -> str:
    """The elements the image rules find, best rule first."""
    found = ", ".join(first_sql(s) for s in rules.IMAGES)
    return f"transform(filter(array({found}), e -> e IS NOT NULL), e -> struct(e AS element, true AS by_rule))"


def _by_size() -> str:
    """Images above 200 by 200, largest first and of equal ones the first on the page.

    Sizes are the ones the page states; there is no layout to measure.
    """
    big = f"filter(elements, e -> e.tag = 'img' AND {_side('width', 'e')} > 200 AND {_side('height', 'e')} > 200)"
    order = f"coalesce(nullif(sign(({_area('b')}) - ({_area('a')})), 0D), sign(a.pos - b.pos))"
    largest_first = f"array_sort({big}, (a, b) -> CAST({order} AS INT))"
    return f"transform({largest_first}, e -> struct(e AS element, false AS by_rule))"


def _usable(candidates: str, page_url: Column) -> Column:
    """The first candidate that is no logo and, if a rule found it, no icon either.

    A plain source counts only on real images, and as resolved against the page.
    """
    named = ", ".join(attr_sql(a, "c.element") for a in rules.IMAGE_ATTRIBUTES)
    stated = f"get(filter(array({named}), t -> t <> ''), 0)"
    own = f"CASE WHEN c.element.tag = 'img' THEN get(filter(array({attr_sql('src', 'c.element')}), t -> t <> ''), 0) END"
    listed = F.expr(
        f"transform({candidates}, c -> struct(IF(c.by_rule, {stated}, NULL) AS stated, {own} AS own, c.by_rule AS by_rule))"
    )
    links = F.transform(
        listed, lambda c: F.struct(F.coalesce(c["stated"], resolve_url(page_url, c["own"])).alias("link"), c["by_rule"].alias("by_rule"))
    )
    fine = F.filter(
        links, lambda c: F.coalesce(~c["link"].contains("logo") & ~(c["by_rule"] & c["link"].contains("icon")), F.lit(False))
    )
    return F.get(fine, F.lit(0))["link"]


def chosen_image(page_url: Column) -> Column:
    """The first rule's image that is neither logo nor icon."""
    return _usable(_by_rule(), page_url)


def largest_image(page_url: Column) -> Column:
    """The largest image above 200 by 200 that is no logo; of equal ones the first."""
    return _usable(_by_size(), page_url)


def image(page_url: Column) -> Column:
    return _usable(f"concat({_by_rule()}, {_by_size()})", page_url)


def favicon() -> Column:
    return F.coalesce(*[attr(s, "href") for s in rules.FAVICONS])


def author() -> Column:
    return meta("author")


def preview_columns(scanned: DataFrame) -> DataFrame:
    """Seven preview fields for scanned pages, whose ``url`` is in normal form already.

    A page without a title keeps its row with blank fields.
    """
    found = scanned.select(
        "page_id", F.col("url").alias("product_link"), title().alias("product_name"), description().alias("description"),
        F.coalesce(image(F.col("url")), meta("image"), attr("img", "src")).alias("image_link"),
        favicon().alias("favicon"), author().alias("author"),
    )
    links = F.transform(F.array("image_link", "favicon"), lambda link: absolute_link(F.col("product_link"), link))
    usable = F.col("product_name").isNotNull()

    def shown(column, name):
        return F.when(usable, column).otherwise("").alias(name)

    return found.select(
        "page_id", "product_link", shown(F.col("product_name"), "product_name"),
        shown(F.col("description"), "description"), links.alias("_links"), usable.alias("_usable"),
        shown(domain(F.col("product_link")), "domain"), shown(F.col("author"), "author"),
    ).select(
        "page_id", "product_link", "product_name", "description",
        F.when(F.col("_usable"), F.col("_links")[0]).otherwise("").alias("image_link"),
        F.when(F.col("_usable"), F.col("_links")[1]).otherwise("").alias("favicon"),
        "domain", "author",
    )


def site_preview(pages: DataFrame, site: str, site_rules: dict | None = None) -> DataFrame:
    """Previews by one retailer's own rules, for pages (page_id, url, html) whose address names the site.

    Missing texts get the default wording; a page with nothing to show gives no record.
    """
    chosen = site_rules or rules.SITE

    def shown(kind):
        return F.coalesce(*[text(s) for s in chosen[kind]])

    found = elements(pages.filter(F.lower("url").contains(site))).select(
        "page_id", "url", shown("title").alias("title"), shown("description").alias("description"),
        F.coalesce(*[first(s) for s in chosen["image"]])["attrs"].alias("picture"),
    )
    source = F.coalesce(
        resolve_url(F.col("url"), filled(F.col("picture")["src"])), filled(F.col("picture")["data-src"]),
        F.get(F.split(filled(F.col("picture")["srcset"]), ","), F.lit(0)),
    )
    fields = found.select(
        "page_id", filled(trim(F.col("title"))).alias("title"), filled(trim(F.col("description"))).alias("description"),
        source.alias("image"),
    )
    something = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("title", "description", "image")])
    return fields.filter(something).na.fill(rules.SITE_DEFAULTS)
