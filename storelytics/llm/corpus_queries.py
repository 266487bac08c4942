"""Registered queries of the conversation trie, the web archives and the spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelytics.llm import prefix_trie, spelling, warc
from storelytics.llm.common import table


def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, folder, "conversations")))


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).drop("url")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(table(spark, folder, "documents"))


QUERIES = {
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie, "op12_warc": op12_warc, "op13_spelling_variants": op13_spelling_variants,
}


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB, bit by bit."""
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: {bits}), 4294967295)"


OP13 = rf"""
WITH t AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents),
r AS (SELECT doc || ':' || run AS s, run, count(*) AS k FROM t GROUP BY doc, run),
h AS (SELECT run, k, {crc32_sql("s")} AS h FROM r),
w AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k) AS n
    FROM h GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
-- Words one edit apart share one of the texts that are left when a letter is taken out, or one is the other without a letter.
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
    SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS (
    SELECT w.word, CAST(w.n AS BIGINT) AS n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
           CAST(CASE WHEN near_n >= 2 * w.n THEN near_n END AS BIGINT) AS form_n
    FROM w LEFT JOIN best USING (word)),
chain AS (
    WITH RECURSIVE c(word, root, form) AS (
        SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
    SELECT word, root FROM c WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN chain USING (word)
"""

OP11 = rf"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
    SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
    UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM r),
-- A prefix is the list of its turns itself.
p AS (SELECT conv_id, depth, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM d),
m AS (
    SELECT conv_id, depth, path, text FROM p
    UNION ALL SELECT conv_id, 0, [], '' FROM c),
l AS (SELECT conv_id, max(depth) AS turns FROM m GROUP BY conv_id),
n AS (
    SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
    FROM m JOIN l USING (conv_id) GROUP BY depth, path),
k AS (
    SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[:n.depth] = n.path) AS n_children
    FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]),
up AS (
    SELECT path[:a.depth] AS path, a.depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
           CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(k.depth + 1)) AS above FROM k) s JOIN (SELECT DISTINCT depth FROM k) a ON a.depth = above GROUP BY 1, 2)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM k JOIN up USING (path, depth)
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS place FROM pages),
l AS (
    SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           first(place) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, place DESC) AS kept_place,
           first(page_id) OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, place DESC) AS kept
    FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND kept_place <> place THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND kept_place <> place THEN kept END AS refers_to
FROM l
"""

ORACLE = {"op11_conversation_prefix_trie": OP11, "op12_warc": OP12, "op13_spelling_variants": OP13}
