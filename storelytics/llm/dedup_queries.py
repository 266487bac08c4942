"""Registered queries of the deduplicating operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.llm import decontaminate, line_dedup, simhash, substrings
from storelytics.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.linked_fingerprints(table(spark, folder, "documents"), words=3, radius=2)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, folder, "documents"), run=3, long_words=35)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"), n=10)


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove(table(spark, folder, "documents"), length=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
}

# Runs of three lines with a word, or of one or two with 35 words, compared as text; lines of all but the first in order of document and place go.
OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, x, p FROM (SELECT r, doc_id, unnest(l) AS x, unnest(range(len(l))) AS p FROM d)),
solid AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) - 1 AS b FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
counted AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM solid),
ahead AS (
    SELECT r, doc_id, b, x, w, lead(x, 1) OVER o AS x1, lead(w, 1) OVER o AS w1, lead(x, 2) OVER o AS x2
    FROM counted WINDOW o AS (PARTITION BY r ORDER BY b)),
runs AS (
    SELECT r, doc_id, b, 3 AS width, x || chr(10) || x1 || chr(10) || x2 AS run FROM ahead
    UNION ALL SELECT r, doc_id, b, 2, x || chr(10) || x1 FROM ahead WHERE w + w1 >= 35
    UNION ALL SELECT r, doc_id, b, 1, x FROM ahead WHERE w >= 35),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, r, b) AS n FROM runs WHERE run IS NOT NULL),
gone AS (SELECT DISTINCT r, unnest(range(b, b + width)) AS b FROM ranked WHERE n > 1),
marked AS (
    SELECT l.r, l.p, l.x, s.b, g.b IS NOT NULL AS goes FROM lines l LEFT JOIN solid s USING (r, p) LEFT JOIN gone g ON g.r = l.r AND g.b = s.b),
-- a blank line goes if the lines with a word on both sides of it go
near AS (
    SELECT *, last_value(CASE WHEN b IS NOT NULL THEN goes END IGNORE NULLS) OVER (PARTITION BY r ORDER BY p) AS before,
           first_value(CASE WHEN b IS NOT NULL THEN goes END IGNORE NULLS) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM marked),
kept AS (
    SELECT r, string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT (coalesce(before, false) AND coalesce(after, false))) AS text,
           count(b) AS n_lines, count(*) FILTER (WHERE goes) AS n_removed
    FROM near GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

# Windows of 10 item words against every start of the same length, all words compared.
OP6 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
    SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT s.r, s.i, s.n, x.item_id FROM starts s JOIN windows x ON s.win = x.win AND s.n = x.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (
    SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

# Windows of 35 words compared as text; every word of one that starts twice goes.
OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN twice USING (g)),
listed AS (SELECT r, count(*) AS n, list(p) AS ps FROM gone GROUP BY r),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

ORACLE: dict[str, str] = {"op5_line_dedup": OP5, "op6_benchmark_decontamination": OP6, "op10_substring_dedup": OP10}
