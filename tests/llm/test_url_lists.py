"""URL filters in time against plain Python and SQL."""

import datetime as dt
import random

from sqlcheck import mismatch

from storelytics.llm import queries, url_lists

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, captures, entries):
    return (
        spark.createDataFrame(captures, "id long, url string, fetched_at timestamp_ntz, pattern string").drop("pattern"),
        spark.createDataFrame(entries, "pattern string, status string, at timestamp_ntz"),
    )


def brute(captures, entries):
    from urllib.parse import urlsplit

    out = []
    good = sorted({(p.lower(), a, s) for p, s, a in entries if p and a and s in ("block", "allow", "remove")})
    for i, url, t, _ in captures:
        keys = []
        if url and "://" in url and urlsplit(url).hostname:
            u = urlsplit(url)
            h = u.hostname.split(".")
            keys = [".".join(h[-n:]) for n in range(min(2, len(h)), len(h) + 1)]
            seg = u.path.split("/")
            keys += [u.hostname + "/".join(seg[:n]) + "/" for n in range(2, len(seg))] + ([u.hostname + u.path] if seg[-1] else [])
        best = None
        for k in keys if t else []:
            past = [(a, s) for p, a, s in good if p == k and a <= t]
            if past and past[-1][1] != "remove":
                best = (k, past[-1][1])
        out.append((i, *(best or (None, None)), bool(best and best[1] == "block")))
    return sorted(out, key=str)


CAPTURES = [
    (1, "https://a.b.example.org/en/x/y.html?q=1#f", DAY(10), ""), (2, "http://USER:pw@A.B.Example.org:8080/en/", DAY(3), ""), (3, None, DAY(1), ""),
    (4, "not a url", DAY(1), ""), (5, "http://localhost", DAY(9), ""), (6, "http://example.org", None, ""), (None, "http://example.org/z", DAY(400), ""),
    (1, "https://a.b.example.org/en/x/y.html?q=1#f", DAY(10), ""), (8, "http:///path", DAY(5), ""),
]
ENTRIES = [
    ("example.org", "block", DAY(2)), ("example.org", "remove", DAY(9)), ("example.org", "block", DAY(300)), ("a.b.example.org/en/", "allow", DAY(3)),
    ("B.example.org", "block", DAY(4)), ("localhost", "block", DAY(9)), ("localhost", "allow", DAY(9)), (None, "block", DAY(1)), ("example.org", "odd", DAY(1)),
    ("example.org", "block", None), ("example.org", "block", DAY(2)),
]


def test_small_lists(spark):
    c, e = frames(spark, CAPTURES, ENTRIES)
    got = url_lists.judge(c, e)
    assert sorted(((r.id, r.pattern, r.status, r.blocked) for r in got.collect()), key=str) == brute(CAPTURES, ENTRIES)
    assert url_lists.judge(c.limit(0), e).count() == 0
    assert {r.blocked for r in url_lists.judge(c, e.limit(0)).collect()} == {False}


def test_a_hot_pattern_over_many_partitions(spark):
    rng = random.Random(4)
    captures = [(i, f"http://h{i % 3 and i % 40}.example.org/{i}", DAY(rng.randrange(300)), "") for i in range(3000)]
    entries = [("example.org", rng.choice(["block", "allow", "remove"]), DAY(rng.randrange(300))) for _ in range(200)]
    entries += [(f"h{rng.randrange(40)}.example.org", rng.choice(["block", "remove"]), DAY(rng.randrange(300))) for _ in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        c, e = frames(spark, captures, entries)
        got = sorted(((r.id, r.pattern, r.status, r.blocked) for r in url_lists.judge(c, e).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(captures, entries)


def test_paths_keep_their_case(spark):
    captures = [(1, "http://example.org/Ads/x", DAY(5), ""), (2, "http://EXAMPLE.org/ads/x", DAY(5), ""), (3, "http://b.org/New/Y/z", DAY(5), "")]
    c, e = frames(spark, captures, [("Example.org/Ads/", "block", DAY(1)), ("B.org/New/Y/z", "block", DAY(1))])
    got = {r.id: (r.pattern, r.blocked) for r in url_lists.judge(c, e).collect()}
    assert got == {1: ("example.org/Ads/", True), 2: (None, False), 3: ("b.org/New/Y/z", True)}


def test_the_plan_reads_no_html(spark):
    plan = queries.queries()["op2_url_filters"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "html" not in plan.split("== Physical Plan ==")[1]


def test_sql(spark):
    assert mismatch(spark, "op2_url_filters") == []
