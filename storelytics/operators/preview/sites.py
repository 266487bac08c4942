"""Previews of retailers' pages by rules that are data, and the chain of sources behind them.

A rule is a row (site, field, rank, selector): for pages of the site the field comes from the selector of least rank that matches an element.
A page belongs to a site if a part of its host is the site's name, and any number of sites goes in one pass. Selectors
are read from the table into steps (tag, id, classes, attributes, states) and matched by expressions over a page's elements.
A selector's own step may use all of these, the steps before it a class or an id, as the page scan keeps no more of ancestors.

``retailer_preview`` asks one source after the other, each only for the rows that those before it left: the site's rules, the product
service's answers, the general preview, and last the site's fixed record. So every page of a known site has a record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.titles import trim
from storelytics.functions.urls import host, resolve_url, second_last_step
from storelytics.operators.preview import cascade, rules
from storelytics.operators.preview.jobs import api_preview
from storelytics.operators.preview.scan import elements
from storelytics.operators.preview.select import filled, text_of
from storelytics.session import cut

FIELDS = ["title", "description", "image"]
_OUTSIDE = r" (?![^\[]*\])"
# The record of a page that no source knows, behind the site's own label.
FALLBACK_TITLE = " Product"
FALLBACK_DESCRIPTION = "Product information temporarily unavailable"


def site_rules(chosen: dict[str, list[str]], site: str) -> list[tuple[str, str, int, str]]:
    """Rows of a rules table from lists of selectors per field."""
    return [(site, field, rank, selector) for field, listed in chosen.items() for rank, selector in enumerate(listed)]


def _step(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    attributes = F.transform(
        F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)),
        lambda a: F.struct(
            F.regexp_extract(a, r"^([\w-]+)", 1).alias("name"), F.regexp_extract(a, r"^[\w-]+(\*?=)", 1).alias("op"),
            F.regexp_extract(a, '="([^"]*)"', 1).alias("value"),
        ),
    )
    return F.struct(
        F.regexp_extract(bare, "^([a-z0-9]+)", 1).alias("tag"), F.regexp_extract(bare, r"#([\w-]+)", 1).alias("id"),
        F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), attributes.alias("attributes"),
        bare.contains(":first-of-type").alias("first_of_type"), bare.contains(":last-child").alias("last_child"),
    )


def parsed(site_rules: DataFrame) -> DataFrame:
    """(site, rules): a site's rules as an array in order of field and rank, selectors taken apart."""
    steps = F.split("selector", _OUTSIDE)
    read = site_rules.select(
        F.lower("site").alias("site"),
        F.struct(
            "field", "rank", "selector", _step(F.element_at(steps, -1)).alias("own"),
            F.transform(F.slice(steps, 1, F.size(steps) - 1), _step).alias("outer"),
        ).alias("rule"),
    )
    return read.groupBy("site").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def _named(step: Column, node: Column) -> Column:
    classes = F.split(node["cls"], "[ \\t\\r\\n\\f]+")
    return ((step["id"] == "") | (node["id"] == step["id"])) & F.forall(step["classes"], lambda c: F.array_contains(classes, c))


def _fits(rule: Column, around: Column, e: Column) -> Column:
    """Does the rule match ``e``? ``around`` holds, for each step before the last, the elements it names."""
    own = rule["own"]

    def stated(a: Column) -> Column:
        value = F.when(a["name"] == "class", e["cls"]).when(a["name"] == "id", e["id"]).otherwise(F.element_at(e["attrs"], a["name"]))
        return F.when(a["op"] == "", value.isNotNull()).when(a["op"] == "=", value == a["value"]).otherwise(value.contains(a["value"]))

    inside = F.forall(around, lambda named: F.exists(named, lambda o: (o["pos"] < e["pos"]) & (e["pos"] <= o["last"])))
    tests = [
        (own["tag"] == "") | (e["tag"] == own["tag"]), _named(own, e), F.forall(own["attributes"], stated),
        ~own["first_of_type"] | e["first_of_type"], ~own["last_child"] | e["last_child"], inside,
    ]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _found(field: str) -> Column:
    """The first element of the field's first rule that matches any."""
    def around(rule):
        return F.transform(rule["outer"], lambda step: F.transform(
            F.filter("elements", lambda o: F.coalesce(_named(step, o), F.lit(False))), lambda o: F.struct(o["pos"].alias("pos"), o["last"].alias("last"))
        ))

    own = F.transform(F.filter("rules", lambda r: r["field"] == field), lambda r: F.struct(r.alias("rule"), around(r).alias("around")))
    found = F.transform(own, lambda r: F.slice(F.filter("elements", lambda e: _fits(r["rule"], r["around"], e)), 1, 1))
    return F.get(F.flatten(found), F.lit(0))


def site_of(url: Column, site_rules: DataFrame) -> Column:
    """The site a host names, of several the first by name. The names, a word per site, go to every task; pages are not moved."""
    names = site_rules.agg(F.collect_set(F.lower("site"))).scalar()
    return F.array_min(F.array_intersect(F.split(F.lower(host(url)), "\\."), names))


def _scanned(pages: DataFrame, site_rules: DataFrame) -> DataFrame:
    """(page_id, url, page_text, elements, site, rules) of the pages of known sites."""
    of = site_of(F.col("url"), site_rules)
    known = pages.select("page_id", "url", "html").withColumn("site", of).filter("site IS NOT NULL")
    return elements(known).withColumn("site", of).join(parsed(site_rules), "site")


def _by_rules(scanned: DataFrame) -> DataFrame:
    first = scanned.select("page_id", "url", "site", "page_text", *[_found(f).alias(f) for f in FIELDS])
    found = first.select(
        "page_id", "url", "site", *[text_of(F.col(f)).alias(f) for f in ("title", "description")], F.col("image")["attrs"].alias("picture")
    )
    source = F.coalesce(
        resolve_url(F.col("url"), filled(F.col("picture")["src"])), filled(F.col("picture")["data-src"]),
        F.get(F.split(filled(F.col("picture")["srcset"]), ","), F.lit(0)),
    )
    fields = found.select(
        "page_id", "url", "site", filled(trim(F.col("title"))).alias("title"), filled(trim(F.col("description"))).alias("description"),
        source.alias("image"),
    )
    return fields.filter("title IS NOT NULL OR description IS NOT NULL OR image IS NOT NULL").na.fill(rules.SITE_DEFAULTS)


def site_previews(pages: DataFrame, site_rules: DataFrame) -> DataFrame:
    """(page_id, site, title, description, image) by each site's own rules.

    ``site_rules``: site, field, rank, selector. Missing texts get the default wording; a page with nothing to show gives no record.
    """
    return _by_rules(_scanned(pages, site_rules)).select("page_id", "site", *FIELDS)


def retailer_preview(pages: DataFrame, site_rules: DataFrame, labels: DataFrame, answers: DataFrame) -> DataFrame:
    """(page_id, site, title, description, image, found_by): a record for every page of a known site.

    ``labels`` (site, label) names the sites; ``answers`` (site, product_id, body) holds the product service's answers by the id that a
    product's address carries. ``found_by`` is rule, service, page or none.
    """
    scanned = cut(_scanned(pages, site_rules))
    key = ["page_id", "url"]
    ruled = cut(_by_rules(scanned).withColumn("found_by", F.lit("rule")))
    left = scanned.join(ruled.select(*key), key, "left_anti")
    asked = left.select(*key, "site", second_last_step(F.col("url")).alias("product_id")).join(answers, ["site", "product_id"])
    # The service's answer is known by its page here, so the mapping needs no more than that.
    served = api_preview(asked.select(F.struct(*key, "site").alias("page_id"), "body")).select("page_id.*", *FIELDS)
    served = cut(served.filter("title IS NOT NULL").withColumn("found_by", F.lit("service")))
    rest = left.join(served.select(*key), key, "left_anti")
    general = rest.select(
        *key, "site", cascade.title().alias("title"), cascade.description().alias("description"), cascade.image(F.col("url")).alias("image")
    ).join(labels, "site", "left")
    usable = F.col("title").isNotNull()
    last = general.select(
        *key, "site", F.coalesce("title", F.concat(F.coalesce("label", "site"), F.lit(FALLBACK_TITLE))).alias("title"),
        F.when(usable, F.col("description")).otherwise(FALLBACK_DESCRIPTION).alias("description"), F.when(usable, F.col("image")).alias("image"),
        F.when(usable, "page").otherwise("none").alias("found_by"),
    )
    return ruled.unionByName(served).unionByName(last).select("page_id", "site", *FIELDS, "found_by")
