"""Page tables with known product data inserted, in the SQL both engines share.

The driver's pages carry a title, a headline and text, but no product data; each page gets one of eight kinds of
head fragment, so every rule has pages to find and pages to miss.
"""

PAGES: dict[str, str] = {
    "pages_plus": """
        SELECT page_id, url, replace(html, '<head>', '<head>' || CASE page_id % 8
            WHEN 1 THEN '<meta property="og:title" content="T' || CAST(page_id AS STRING) || '">'
            WHEN 2 THEN '<script type="application/ld+json">{{"@type":"Product","name":"P' || CAST(page_id AS STRING)
                || '"}}</script><meta property="og:title" content="T2">'
            WHEN 3 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":"Organization","name":"Org"}},'
                || '{{"@type":"IndividualProduct","name":"G' || CAST(page_id AS STRING) || '"}}]}}</script>'
            WHEN 4 THEN '<script type="application/ld+json">{{"@type":"Product","name":</script>'
                || '<meta name="twitter:title" content=" W' || CAST(page_id AS STRING) || ' ">'
            WHEN 5 THEN '<meta name="description" content="About ' || CAST(page_id AS STRING) || '">'
                || '<meta name="author" content="A' || CAST(page_id AS STRING) || '"><link rel="icon" href="/i.png">'
            WHEN 6 THEN '<meta property="og:author" content="OG"><link rel="shortcut icon" href="../s.ico">'
                || '<link rel="icon" href="/i.png"><div class="pdp-image"><img src="/logo.png"></div>'
                || '<meta property="og:image" content="img/p' || CAST(page_id AS STRING) || '.png">'
            WHEN 7 THEN '<img src="/s.png" width="100" height="100"><img src="/m' || CAST(page_id AS STRING)
                || '.png" width="300" height="300"><img src="/n.png" width="300" height="300">'
            ELSE '' END) AS html
        FROM {pages}""",
    "site_pages": """
        SELECT page_id, url, replace(html, '<body>', '<body>' || CASE page_id % 4
            WHEN 1 THEN '<h1 class="big title"> H' || CAST(page_id AS STRING)
                || ' </h1><img class="img-responsive" data-src="/d.png" alt="x">'
            WHEN 2 THEN '<div class="pdp-name">N' || CAST(page_id AS STRING)
                || '</div><div class="index-productDescriptors"> D &amp; E </div>'
            WHEN 3 THEN '<div id="x"><div class="pdp-image"><p><img srcset="/a.png 1x,/b.png 2x"></p></div></div>'
            ELSE '' END) AS html
        FROM {pages}""",
    # Pages of two retailers and of neither: with product data, with a headline only, and with nothing at all.
    "retailer_pages": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.shopone.example/a/' || CAST(page_id AS STRING) || '/buy'
            WHEN 1 THEN 'http://m.ShopTwo.example.net/' || CAST(page_id AS STRING) || '/' ELSE url END AS url,
            CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN '<meta property="og:title" content="G' || CAST(page_id AS STRING) || '">'
            WHEN page_id % 3 = 0 THEN '<div class="box"><b class="pdp-name x">One ' || CAST(page_id AS STRING)
                || '</b><p id="about">Fine &amp; good</p></div><img class="img-responsive" src="/one.png">'
            ELSE '<div class="box"><b class="pdp-name x">No rule</b></div><h2 data-role="head">Two ' || CAST(page_id AS STRING)
                || '</h2><div id="gallery"><a><img data-src="/two.png"></a></div>' END AS html
        FROM {pages}""",
    "retailer_rules": """
        SELECT CASE WHEN page_id < 4 THEN 'shopone' ELSE 'shoptwo' END AS site,
            CASE page_id WHEN 2 THEN 'description' WHEN 5 THEN 'description' WHEN 3 THEN 'image' WHEN 6 THEN 'image' ELSE 'title' END AS field,
            CASE WHEN page_id = 1 THEN 1 ELSE 0 END AS rank,
            CASE page_id WHEN 0 THEN 'h1.missing' WHEN 1 THEN '.box .pdp-name' WHEN 2 THEN 'p#about' WHEN 3 THEN 'img.img-responsive'
                WHEN 4 THEN '[data-role="head"]' WHEN 5 THEN 'p[class*="about"]' ELSE '#gallery img' END AS selector
        FROM {pages} WHERE page_id < 7""",
    "retailer_labels": """
        SELECT CASE WHEN page_id = 0 THEN 'shopone' ELSE 'other' || CAST(page_id AS STRING) END AS site, 'Shop One' AS label
        FROM {pages} WHERE page_id < 3""",
    "retailer_answers": """
        SELECT CASE page_id % 3 WHEN 0 THEN 'shopone' ELSE 'shoptwo' END AS site, CAST(page_id AS STRING) AS product_id,
            CASE page_id % 5 WHEN 0 THEN 'oops' ELSE '{{"style":{{"name":"S' || CAST(page_id AS STRING)
                || '","description":"served","media":{{"photos":[]}}}}}}' END AS body
        FROM {pages} WHERE page_id % 2 = 0""",
    "page_titles": """
        SELECT page_id, CASE page_id % 4 WHEN 1 THEN ' -- ' WHEN 2 THEN 'A – ' ELSE '' END
            || regexp_extract(html, '<title>([^<]*)</title>', 1)
            || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  | Shop' ELSE ' - Shop - Home' END AS title
        FROM {pages}""",
    "page_links": """
        SELECT page_id, url, CASE page_id % 12 WHEN 0 THEN 'https://CDN.example.org:443/a/./b/../c.png' WHEN 1 THEN '//cdn.example.org/x.png'
            WHEN 2 THEN '/img/../y.png' WHEN 3 THEN 'z.png' WHEN 4 THEN '../up/w.png' WHEN 5 THEN '?page=9' WHEN 6 THEN '#part'
            WHEN 7 THEN '' WHEN 8 THEN 'a b/c.png' WHEN 9 THEN './..' WHEN 10 THEN '/für/é.png?q=ü' ELSE '../../../v.png' END AS link
        FROM {pages}""",
    "page_addresses": """
        SELECT page_id, CASE page_id % 10 WHEN 0 THEN upper(substr(url, 1, 12)) || substr(url, 13) WHEN 1 THEN ''
            WHEN 2 THEN 'no address' WHEN 3 THEN NULL WHEN 4 THEN '/' || url WHEN 5 THEN 'http://'
            WHEN 6 THEN 'https://www.a-www.b.example.com:8080' ELSE url END AS url
        FROM {pages}""",
    "api_answers": """
        SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN '{{"error":1}}' WHEN 1 THEN 'oops'
            WHEN 2 THEN '{{"style":{{"name":"","brand":"' || p_brand || '","description":"' || p_type || '","media":{{"photos":[]}}}}}}'
            ELSE '{{"style":{{"name":"' || p_name || '","brand":"' || p_brand || '","description":"' || p_type
                || '","media":{{"photos":[{{"secureSrc":"https://img/' || CAST(p_partkey AS STRING) || '.png"}}]}}}}}}' END AS body
        FROM {part}""",
    "resources": """
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'script' WHEN 3 THEN 'font'
                WHEN 4 THEN 'other' WHEN 5 THEN 'xhr' ELSE 'stylesheet' END AS resource_type,
            'https://cdn.example.com/' || CASE event_id % 23 WHEN 1 THEN 'tracking/' WHEN 2 THEN 'metrics/' WHEN 3 THEN 'advertisement/'
                WHEN 4 THEN 'unagi/' WHEN 5 THEN 'Sushi/' WHEN 6 THEN 'TRACK/' WHEN 7 THEN 'report/' WHEN 8 THEN 'etracker/' ELSE '' END
            || CASE event_id % 9 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'jquery.js' WHEN 2 THEN 'Main.js'
                WHEN 3 THEN 'sprite.png' WHEN 4 THEN 'analytics.js' WHEN 5 THEN 'Sponsored/x.png' WHEN 6 THEN 'gateway/v2/product/7'
                WHEN 7 THEN 'favicon.jpeg' ELSE 'p.png' END AS url
        FROM {events}""",
    "mail_rows": """
        SELECT c_custkey AS user_id, CASE c_custkey % 8 WHEN 0 THEN 'A@Hotmail.com' WHEN 1 THEN 'b@gmail.com'
            WHEN 2 THEN 'c@MSN.COM' WHEN 3 THEN 'nobody' WHEN 4 THEN NULL WHEN 5 THEN ''
            WHEN 6 THEN 'd@live.com@gmail.com' ELSE lower(c_name) || '@example.com' END AS email
        FROM {customer}""",
    "product_links": """
        SELECT p_partkey AS product_id, CASE WHEN p_partkey % 10 = 0 THEN 'plain' ELSE
            'https://shop.example.com/' || p_type || '/' || CAST(p_partkey AS STRING) || '/buy' END AS url
        FROM {part}""",
}
