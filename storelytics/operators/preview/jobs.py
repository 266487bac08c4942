"""Preview jobs over whole page tables, and the smaller checks around fetching pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.urls import normal_url
from storelytics.operators.preview.cascade import preview_columns
from storelytics.operators.preview.scan import elements

# Resource types and address words that are never loaded.
BLOCKED_TYPES = ["media", "font", "websocket", "manifest", "other"]
BLOCKED_WORDS = [
    "analytics", "tracking", "metrics", "advertisement", "sponsored", "unagi", "sushi", "track", "report", "etracker",
]
IMAGE_SKIPPED = ["sprite", "icon"]
SCRIPT_WORDS = ["jquery", "main"]
IMAGE_ENDINGS = [".jpg", ".jpeg", ".png"]
PRODUCT_API = "gateway/v2/product"

# Phrases of log lines that carry no information.
NOISE = [
    "net::ERR_FAILED",
    "Failed to fetch",
    "preloaded using link preload",
    "Failed to load resource",
    "Track&Report",
    "WebGL",
    "Metric emission failed",
    "error on etracker",
    "TypeError: Failed to fetch",
    "Warning -- sushi response",
    "MSAVowelsJavascriptAssets",
]

# Mail provider by domain; all other domains count as the default.
PROVIDERS = {
    "gmail.com": "gmail",
    "googlemail.com": "gmail",
    "outlook.com": "outlook",
    "hotmail.com": "outlook",
    "live.com": "outlook",
    "msn.com": "outlook",
}
DEFAULT_PROVIDER = "gmail"


def valid_urls(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with their address in normal form, and the rest with a reason."""
    judged = pages.withColumn("product_link", normal_url(F.col("url")))
    missing = F.coalesce(F.col("url") == "", F.lit(True))
    reason = F.when(missing, "URL is required").otherwise("Invalid URL format")
    good = F.col("product_link").isNotNull()
    return judged.filter(good), judged.filter(~good).select("page_id", "url", reason.alias("reason"))


def link_preview(pages: DataFrame) -> DataFrame:
    """Preview records for (page_id, url, html): valid addresses only, one row per page."""
    good, _ = valid_urls(pages.select("page_id", "url", "html"))
    return preview_columns(elements(good.select("page_id", F.col("product_link").alias("url"), "html")))


def api_preview(answers: DataFrame) -> DataFrame:
    """Product-service answers (page_id, body JSON) in the shape of a preview; answers without a style give none."""
    style = F.from_json(
        "body",
        "style struct<name:string, brand:string, description:string, media:struct<photos:array<struct<secureSrc:string>>>>",
    )["style"]
    read = answers.withColumn("_s", style).filter(F.col("_s").isNotNull())
    name, text = F.col("_s.name"), F.col("_s.description")
    picture = F.get(F.col("_s.media.photos"), F.lit(0))["secureSrc"]
    # Fixed value: the page that stands for an answer.
    page = F.format_string(
        '<html><head><title>%s</title><meta name="description" content="%s"></head>'
        '<body><h1>%s</h1><img src="%s" alt="%s"><p>%s</p></body></html>',
        name, text, name, picture, name, text,
    )
    return read.select(
        "page_id", F.coalesce(F.when(name != "", name), F.col("_s.brand")).alias("title"), text.alias("description"),
        picture.alias("image"), page.alias("content"),
    )


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify_resources(resources: DataFrame) -> DataFrame:
    """Add ``action``, allow or block, for page resources (resource_type, url)."""
    kind, url = F.col("resource_type"), F.lower("url")
    action = (
        F.when(kind.isin(BLOCKED_TYPES) | _has(url, BLOCKED_WORDS), "block")
        .when(kind == "document", "allow")
        .when((kind == "image") & ~_has(url, IMAGE_SKIPPED), "allow")
        .when((kind == "script") & _has(url, SCRIPT_WORDS), "allow")
        .otherwise("block")
    )
    return resources.withColumn("action", action)


def classify_retailer_resources(resources: DataFrame) -> DataFrame:
    """As ``classify_resources`` with one retailer's narrower rule: page, product service and photos only."""
    kind, url = F.col("resource_type"), F.lower("url")
    photo = (kind == "image") & _has(url, IMAGE_ENDINGS) & ~_has(url, IMAGE_SKIPPED)
    wanted = (kind == "document") | url.contains(PRODUCT_API) | photo
    return resources.withColumn("action", F.when(wanted, "allow").otherwise("block"))


def drop_noise(logs: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Log lines that hold none of the phrases, ignoring case."""
    noisy = _has(F.lower("text"), [p.lower() for p in (phrases or NOISE)])
    return logs.filter(~F.coalesce(noisy, F.lit(False)))


def mail_provider(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``provider`` by mail domain; rows without an address are rejected."""
    named = F.col("email") != ""
    place = F.get(F.split(F.lower("email"), "@"), F.lit(1))
    provider = F.lit(DEFAULT_PROVIDER)
    for name in sorted(set(PROVIDERS.values())):
        provider = F.when(place.isin([d for d, p in PROVIDERS.items() if p == name]), name).otherwise(provider)
    usable = F.coalesce(named, F.lit(False))
    rejects = rows.filter(~usable).withColumn("reason", F.lit("Invalid email address"))
    return rows.filter(usable).withColumn("provider", provider), rejects
