"""Registered queries of the quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelytics.llm import kneser_ney, quality_rules, rule_ensemble
from storelytics.llm.common import table


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.scored(table(spark, folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return rule_ensemble.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


QUERIES = {"op4_lm_scoring": op4_lm_scoring, "op7_quality_classifier": op7_quality_classifier, "op8_quality_rules": op8_quality_rules}


def _ladder_sql() -> str:
    """The ladders as rows (rule, step, cutoff)."""
    rows = [f"('{r}', {i}, {float(c)!r}::DOUBLE)" for r, ladder in quality_rules.LADDERS.items() for i, c in enumerate(ladder)]
    return ", ".join(rows)


OP8 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (r, g)) GROUP BY r),
c AS (
    SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM t JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
m AS (
    SELECT *, n_symbols / nullif(n_words, 0) AS symbol_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
           n_repeat_words / nullif(n_words, 0) AS repeat_share, word_chars / nullif(n_words, 0) AS word_length,
           -(word_chars / nullif(n_words, 0)) AS short_words
    FROM c),
ladder(rule, step, cutoff) AS (VALUES {_ladder_sql()}),
good AS (SELECT * FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
rates AS (
    SELECT stratum, rule, rate FROM good,
        LATERAL (VALUES ('symbol_share', symbol_share), ('dup_line_share', dup_line_share), ('repeat_share', repeat_share),
                        ('word_length', word_length), ('short_words', short_words)) v(rule, rate)),
k AS (
    SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE rate > cutoff) AS k
    FROM rates JOIN ladder USING (rule) GROUP BY ALL),
p AS (
    SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(
        lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - (CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END)
        + i * ln({quality_rules.RISK} / 5) + (n - i) * ln(1 - {quality_rules.RISK} / 5)))) AS p,
        (SELECT count(DISTINCT stratum) FROM good) AS strata
    FROM k),
s AS (SELECT *, min(CASE WHEN p <= {quality_rules.ERROR} / (5 * strata) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS holds FROM p),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM s WHERE holds = 1 GROUP BY stratum, rule),
wide AS (
    SELECT stratum, min(cutoff) FILTER (WHERE rule = 'symbol_share') AS c1, min(cutoff) FILTER (WHERE rule = 'dup_line_share') AS c2,
           min(cutoff) FILTER (WHERE rule = 'repeat_share') AS c3, min(cutoff) FILTER (WHERE rule = 'word_length') AS c4,
           min(cutoff) FILTER (WHERE rule = 'short_words') AS c5
    FROM cuts GROUP BY stratum),
b AS (
    SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           concat_ws(',', CASE WHEN symbol_share > c1 THEN 'symbol_share' END, CASE WHEN dup_line_share > c2 THEN 'dup_line_share' END,
               CASE WHEN repeat_share > c3 THEN 'repeat_share' END, CASE WHEN word_length > c4 THEN 'word_length' END,
               CASE WHEN short_words > c5 THEN 'short_words' END) AS broken_rules
    FROM m LEFT JOIN wide USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM b
"""

ORACLE = {"op8_quality_rules": OP8}
