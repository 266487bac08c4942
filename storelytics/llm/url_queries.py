"""The registered query of the URL filter. Fetch times and list entries are derived from the pages themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.llm import url_lists
from storelytics.llm.common import table


def _number(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 6), 16, 10) AS bigint)"


def captures(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.withColumn("fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id * 7919 % 8784 AS int))"))


def entries(pages: DataFrame) -> DataFrame:
    """Hosts, their parent domains and their directories put on and taken off the list, up to four times each."""
    found = pages.select(F.explode(url_lists.patterns("url")).alias("pattern")).filter("pattern NOT RLIKE '[^/]/.*[^/]$'").distinct()
    times = found.select("pattern", F.expr(f"explode(sequence(0, cast({_number('pattern')} % 5 AS int)))").alias("k")).filter("k > 0")
    return times.select(
        "pattern", F.expr(f"element_at(array('block', 'allow', 'remove'), 1 + cast({_number('concat(pattern, k)')} % 3 AS int))").alias("status"),
        F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast({_number('concat(k, pattern)')} % 366 AS int))").alias("at"),
    )


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = captures(spark, folder)
    return url_lists.judge(pages, entries(pages))


QUERIES = {"op2_url_filters": op2_url_filters}

# Entries as intervals by lead(), a range join, and the most specific pattern in force.
OP2 = r"""
WITH c AS (
    SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id * 7919 % 8784 AS INTEGER)) AS fetched_at,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
    FROM pages),
s AS (SELECT *, string_split(host, '.') AS l, string_split(path, '/') AS s FROM c WHERE host <> ''),
p AS (
    SELECT r, fetched_at, n AS rank, array_to_string(l[len(l) - n + 1:], '.') AS pattern
    FROM (SELECT *, unnest(range(least(2, len(l)), len(l) + 1)) AS n FROM s)
    UNION ALL
    SELECT r, fetched_at, 100 + n, host || array_to_string(s[1:n], '/') || '/' FROM (SELECT *, unnest(range(2, len(s))) AS n FROM s)
    UNION ALL
    SELECT r, fetched_at, 1000000, host || path FROM s WHERE len(s) >= 2 AND s[len(s)] <> ''),
listed AS (
    SELECT pattern, unnest(range(1, CAST(('0x' || substr(md5(pattern), 1, 6))::BIGINT % 5 AS INTEGER) + 1)) AS k
    FROM (SELECT DISTINCT pattern FROM p WHERE NOT regexp_matches(pattern, '[^/]/.*[^/]$'))),
e AS (
    SELECT DISTINCT pattern, ['block', 'allow', 'remove'][1 + ('0x' || substr(md5(pattern || k), 1, 6))::BIGINT % 3] AS status,
           TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(md5(k || pattern), 1, 6))::BIGINT % 366 AS INTEGER)) AS changed
    FROM listed),
v AS (SELECT pattern, status, changed AS since, lead(changed) OVER (PARTITION BY pattern ORDER BY changed, status) AS until FROM e),
f AS (
    SELECT p.r, p.rank, v.pattern, v.status, v.since, v.until FROM p JOIN v
    ON p.pattern = v.pattern AND p.fetched_at >= v.since AND (v.until IS NULL OR p.fetched_at < v.until) AND v.status <> 'remove'),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY rank DESC) = 1)
SELECT page_id, url, fetched_at, pattern, status, since, until, coalesce(status = 'block', false) AS blocked FROM c LEFT JOIN b USING (r)
"""

ORACLE = {"op2_url_filters": OP2}
