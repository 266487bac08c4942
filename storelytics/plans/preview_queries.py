"""Registered page-preview queries and the SQL that checks them."""

from pyspark.sql import functions as F

from storelytics.functions.titles import clean_title, title_part
from storelytics.functions.urls import domain, resolve_url, second_last_step
from storelytics.operators.preview import cascade as C
from storelytics.operators.preview import jobs as J
from storelytics.operators.preview import sites as R
from storelytics.operators.preview.scan import elements
from storelytics.operators.refresh import refresh_due
from storelytics.plans.report_queries import with_tables

LOG_PHRASES = ["License", "KEY-", "click HERE", "password", "Nicht"]


def _scanned(t):
    return elements(t.pages_plus)


def _pick(name, column):
    def build(t):
        return _scanned(t).select("page_id", column().alias(name))

    return build


def _count(tag):
    return F.size(F.filter("elements", lambda e: e["tag"] == tag)).alias(f"n_{tag}")


def _metas(t):
    return _scanned(t).select(
        "page_id", *[C.meta(n).alias(f"meta_{n}") for n in ("title", "description", "author")]
    )


QUERIES = {
    "p01_valid_urls": lambda t: J.valid_urls(t.page_addresses)[0].select("page_id", "product_link"),
    "p01_rejected_urls": lambda t: J.valid_urls(t.page_addresses)[1],
    "p02_domain": lambda t: J.valid_urls(t.page_addresses)[0].select("page_id", domain(F.col("product_link")).alias("domain")),
    "p03_element_counts": lambda t: _scanned(t).select(
        "page_id", *[_count(tag) for tag in ("title", "meta", "h1", "p", "img", "link")]
    ),
    "p04_meta_cascade": _metas,
    "p05_jsonld_name": _pick("product_name", C.linked_name),
    "p06_title": _pick("title", C.title),
    "p07_clean_title": lambda t: t.page_titles.select("page_id", clean_title(F.col("title")).alias("title")),
    "p08_title_part": lambda t: t.page_titles.select("page_id", title_part(F.col("title")).alias("title")),
    "p09_description": _pick("description", C.description),
    "p10_image": lambda t: _scanned(t).select("page_id", C.chosen_image(F.col("url")).alias("image")),
    "p11_largest_image": lambda t: _scanned(t).select(
        "page_id", C.largest_image(F.col("url")).alias("image")
    ),
    "p12_favicon": _pick("favicon", C.favicon),
    "p13_author": _pick("author", C.author),
    "p14_resolve_url": lambda t: t.page_links.select("page_id", resolve_url(F.col("url"), F.col("link")).alias("target")),
    "p15_link_preview": lambda t: J.link_preview(t.pages_plus),
    "p16_site_preview": lambda t: C.site_preview(t.site_pages, "example"),
    "p16_site_rules": lambda t: R.site_previews(t.retailer_pages, t.retailer_rules),
    "p18_retailer_chain": lambda t: R.retailer_preview(t.retailer_pages, t.retailer_rules, t.retailer_labels, t.retailer_answers),
    "p17_url_product_id": lambda t: t.product_links.select("product_id", second_last_step(F.col("url")).alias("url_id")),
    "p18_api_preview": lambda t: J.api_preview(t.api_answers),
    "p19_resource_class": lambda t: J.classify_resources(t.resources),
    "p19_retailer_resource_class": lambda t: J.classify_retailer_resources(t.resources),
    "p20_drop_noise": lambda t: J.drop_noise(t.log_lines, LOG_PHRASES),
    "p20_default_phrases": lambda t: J.drop_noise(t.noisy_lines),
    "p21_refresh_due": lambda t: refresh_due(t.url_requests),
    "p22_mail_provider": lambda t: J.mail_provider(t.mail_rows)[0],
    "p22_mail_rejects": lambda t: J.mail_provider(t.mail_rows)[1],
}


def _plain(markup: str) -> str:
    """Markup without tags and with the entities of the test pages decoded."""
    text = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{char}', 'g')"
    return text


def _clean(text: str) -> str:
    tidy = f"regexp_replace(trim({text}), '[ \\t\\r\\n]+', ' ', 'g')"
    bare = f"regexp_replace({tidy}, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '\\| .*$', ''), '- .*$', ''))"


BODY = """regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs')"""
KIND = "page_id % 8"
TITLE = f"""CASE {KIND} WHEN 1 THEN 'T' || page_id WHEN 2 THEN 'P' || page_id WHEN 3 THEN 'G' || page_id
    WHEN 4 THEN 'W' || page_id ELSE {_clean(_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))} END"""
DESCRIPTION = f"""CASE WHEN {KIND} = 5 THEN 'About ' || page_id ELSE {_plain(
    f"regexp_extract({BODY}, '<p>(.*?)(</p>|<p>|</article>|</div>|<footer>|</body>|$)', 1, 's')")} END"""
AUTHOR = f"CASE {KIND} WHEN 5 THEN 'A' || page_id WHEN 6 THEN 'OG' END"
ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
DIR = f"regexp_replace({PATH}, '[^/]*$', '')"
UP = f"regexp_replace({DIR}, '[^/]+/$', '')"
QUERY = "regexp_extract(url, '([?][^#]*)', 1)"


def _pages(select: str) -> str:
    return with_tables("pages_plus", f"SELECT page_id, {select} FROM t_pages_plus")


def _n(tag: str) -> str:
    return f"CAST(len(regexp_extract_all({BODY}, '<{tag}[ >]')) AS INTEGER) AS n_{tag}"


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(url), '{w}')" for w in words) + ")"


ORACLE = {
    "p01_valid_urls": with_tables(
        "page_addresses",
        """SELECT page_id, CASE WHEN page_id % 10 = 6 THEN url || '/' ELSE lower(url) END AS product_link
        FROM t_page_addresses WHERE page_id % 10 NOT IN (1, 2, 3, 4, 5)""",
    ),
    "p01_rejected_urls": with_tables(
        "page_addresses",
        """SELECT page_id, url, CASE WHEN coalesce(url, '') = '' THEN 'URL is required' ELSE 'Invalid URL format' END AS reason
        FROM t_page_addresses WHERE page_id % 10 IN (1, 2, 3, 4, 5)""",
    ),
    "p02_domain": with_tables(
        "page_addresses",
        """SELECT page_id, CASE WHEN page_id % 10 = 6 THEN 'a-www.b.example.com' ELSE
        regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), 'www[.]', '') END AS domain
        FROM t_page_addresses WHERE page_id % 10 NOT IN (1, 2, 3, 4, 5)""",
    ),
    "p03_element_counts": _pages(", ".join(_n(tag) for tag in ("title", "meta", "h1", "p", "img", "link"))),
    "p04_meta_cascade": _pages(
        f"""CASE {KIND} WHEN 1 THEN 'T' || page_id WHEN 2 THEN 'T2' WHEN 4 THEN ' W' || page_id || ' ' END AS meta_title,
        CASE WHEN {KIND} = 5 THEN 'About ' || page_id END AS meta_description, {AUTHOR} AS meta_author"""
    ),
    "p05_jsonld_name": _pages(f"CASE {KIND} WHEN 2 THEN 'P' || page_id WHEN 3 THEN 'G' || page_id END AS product_name"),
    "p06_title": _pages(f"{TITLE} AS title"),
    "p07_clean_title": with_tables("page_titles", f"SELECT page_id, {_clean('title')} AS title FROM t_page_titles"),
    "p08_title_part": with_tables(
        "page_titles",
        """SELECT page_id, coalesce(list_filter(list_transform(regexp_split_to_array(title, '[|–—-]'), lambda p: trim(p)),
        lambda p: length(p) > 3)[1], title) AS title FROM t_page_titles""",
    ),
    "p09_description": _pages(f"{DESCRIPTION} AS description"),
    "p10_image": _pages(f"CASE WHEN {KIND} = 6 THEN 'img/p' || page_id || '.png' END AS image"),
    "p11_largest_image": _pages(f"CASE WHEN {KIND} = 7 THEN {ORIGIN} || '/m' || page_id || '.png' END AS image"),
    "p12_favicon": _pages(f"CASE {KIND} WHEN 5 THEN '/i.png' WHEN 6 THEN '../s.ico' END AS favicon"),
    "p13_author": _pages(f"{AUTHOR} AS author"),
    "p14_resolve_url": with_tables(
        "page_links",
        f"""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'https://cdn.example.org/a/c.png'
        WHEN 1 THEN regexp_extract(url, '^https?') || '://cdn.example.org/x.png' WHEN 2 THEN {ORIGIN} || '/y.png'
        WHEN 3 THEN {ORIGIN} || {DIR} || 'z.png' WHEN 4 THEN {ORIGIN} || {UP} || 'up/w.png'
        WHEN 5 THEN {ORIGIN} || {PATH} || '?page=9' WHEN 6 THEN {ORIGIN} || {PATH} || {QUERY} || '#part'
        WHEN 7 THEN {ORIGIN} || {PATH} || {QUERY} WHEN 8 THEN {ORIGIN} || {DIR} || 'a%20b/c.png'
        WHEN 9 THEN {ORIGIN} || {UP} WHEN 10 THEN {ORIGIN} || '/f%C3%BCr/%C3%A9.png?q=%C3%BC'
        ELSE {ORIGIN} || '/v.png' END AS target FROM t_page_links""",
    ),
    "p15_link_preview": _pages(
        f"""url AS product_link, {TITLE} AS product_name, {DESCRIPTION} AS description,
        CASE {KIND} WHEN 6 THEN {ORIGIN} || {DIR} || 'img/p' || page_id || '.png'
            WHEN 7 THEN {ORIGIN} || '/m' || page_id || '.png' END AS image_link,
        CASE {KIND} WHEN 5 THEN {ORIGIN} || '/i.png' WHEN 6 THEN {ORIGIN} || {UP} || 's.ico' END AS favicon,
        regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), 'www[.]', '') AS domain, {AUTHOR} AS author"""
    ),
    "p16_site_preview": with_tables(
        "site_pages",
        """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'H' || page_id WHEN 2 THEN 'N' || page_id
            ELSE 'Product Title Not Available' END AS title,
        CASE WHEN page_id % 4 = 2 THEN 'D & E' ELSE 'No description available' END AS description,
        CASE page_id % 4 WHEN 1 THEN '/d.png' WHEN 3 THEN '/a.png 1x' END AS image
        FROM t_site_pages WHERE page_id % 4 <> 0 AND contains(lower(url), 'example')""",
    ),
    "p16_site_rules": with_tables(
        "retailer_pages",
        """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'shopone' ELSE 'shoptwo' END AS site,
        CASE page_id % 3 WHEN 0 THEN 'One ' ELSE 'Two ' END || page_id AS title,
        CASE page_id % 3 WHEN 0 THEN 'Fine & good' ELSE 'No description available' END AS description,
        CASE page_id % 3 WHEN 0 THEN 'https://www.shopone.example/one.png' ELSE '/two.png' END AS image
        FROM t_retailer_pages WHERE page_id % 3 < 2 AND page_id % 7 > 1""",
    ),
    # A page without product data asks the service (even ids, answers of ids that five divides are no answer), then its own title.
    "p18_retailer_chain": with_tables(
        "retailer_pages",
        """, k AS (SELECT page_id, page_id % 3 = 0 AS one, CASE WHEN page_id % 7 > 1 THEN 'rule'
            WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN 'service' WHEN page_id % 7 = 1 THEN 'page' ELSE 'none' END AS found_by
            FROM t_retailer_pages WHERE page_id % 3 < 2)
        SELECT page_id, CASE WHEN one THEN 'shopone' ELSE 'shoptwo' END AS site,
        CASE found_by WHEN 'rule' THEN CASE WHEN one THEN 'One ' ELSE 'Two ' END || page_id WHEN 'service' THEN 'S' || page_id
            WHEN 'page' THEN 'G' || page_id ELSE CASE WHEN one THEN 'Shop One Product' ELSE 'shoptwo Product' END END AS title,
        CASE found_by WHEN 'rule' THEN CASE WHEN one THEN 'Fine & good' ELSE 'No description available' END WHEN 'service' THEN 'served'
            WHEN 'none' THEN 'Product information temporarily unavailable' END AS description,
        CASE WHEN found_by = 'rule' THEN CASE WHEN one THEN 'https://www.shopone.example/one.png' ELSE '/two.png' END END AS image, found_by
        FROM k""",
    ),
    "p17_url_product_id": with_tables(
        "product_links",
        """SELECT product_id, CASE WHEN product_id % 10 = 0 THEN 'plain' ELSE CAST(product_id AS VARCHAR) END AS url_id
        FROM t_product_links""",
    ),
    "p18_api_preview": with_tables(
        "products",
        """SELECT product_id AS page_id, CASE WHEN product_id % 5 = 2 THEN description ELSE name END AS title,
        category AS description, CASE WHEN product_id % 5 <> 2 THEN 'https://img/' || product_id || '.png' END AS image,
        format('<html><head><title>{0}</title><meta name="description" content="{1}"></head><body><h1>{0}</h1><img src="{2}" alt="{0}"><p>{1}</p></body></html>',
            CASE WHEN product_id % 5 = 2 THEN '' ELSE name END, category,
            CASE WHEN product_id % 5 = 2 THEN 'null' ELSE 'https://img/' || product_id || '.png' END) AS content
        FROM t_products WHERE product_id % 5 NOT IN (0, 1)""",
    ),
    "p19_resource_class": with_tables(
        "resources",
        f"""SELECT *, CASE WHEN resource_type IN ('media', 'font', 'websocket', 'manifest', 'other')
            OR {_has(['analytics', 'tracking', 'metrics', 'advertisement', 'sponsored', 'unagi', 'sushi', 'track', 'report', 'etracker'])}
            THEN 'block' WHEN resource_type = 'document' THEN 'allow'
        WHEN resource_type = 'image' AND NOT {_has(['sprite', 'icon'])} THEN 'allow'
        WHEN resource_type = 'script' AND {_has(['jquery', 'main'])} THEN 'allow' ELSE 'block' END AS action FROM t_resources""",
    ),
    "p19_retailer_resource_class": with_tables(
        "resources",
        f"""SELECT *, CASE WHEN resource_type = 'document' OR {_has(['gateway/v2/product'])} OR (resource_type = 'image'
            AND {_has(['.jpg', '.jpeg', '.png'])} AND NOT {_has(['sprite', 'icon'])}) THEN 'allow' ELSE 'block' END AS action
        FROM t_resources""",
    ),
    "p20_drop_noise": with_tables(
        "log_lines",
        "SELECT log_id, text FROM t_log_lines WHERE NOT ("
        + " OR ".join(f"contains(lower(text), '{p.lower()}')" for p in LOG_PHRASES)
        + ")",
    ),
    "p20_default_phrases": with_tables("noisy_lines", "SELECT log_id, text FROM t_noisy_lines WHERE log_id % 18 > 10"),
    "p21_refresh_due": with_tables(
        "url_requests",
        """, kept AS (SELECT url, min("at") AS "at" FROM t_url_requests GROUP BY url
        UNION ALL SELECT k.url, n."at" FROM kept k, LATERAL (SELECT min(r."at") AS "at" FROM t_url_requests r
            WHERE r.url = k.url AND r."at" >= k."at" + INTERVAL 24 HOUR) n WHERE n."at" IS NOT NULL)
        SELECT url, "at" FROM kept""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "p22_mail_provider": with_tables(
        "mail_rows",
        """SELECT user_id, email, CASE WHEN split_part(lower(email), '@', 2) IN ('outlook.com', 'hotmail.com', 'live.com',
        'msn.com') THEN 'outlook' ELSE 'gmail' END AS provider FROM t_mail_rows WHERE email <> ''""",
    ),
    "p22_mail_rejects": with_tables(
        "mail_rows",
        "SELECT user_id, email, 'Invalid email address' AS reason FROM t_mail_rows WHERE coalesce(email, '') = ''",
    ),
}
