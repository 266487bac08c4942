"""Heavy keys: nothing is lost, no array outgrows its limit, and both ways give the same rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from storelytics.functions import nest
from storelytics.functions.ids import dense_ids
from storelytics.operators import requests as Q
from storelytics.operators.intake import gate_items
from storelytics.functions.ordered import ranged
from storelytics.operators.refresh import refresh_due
from storelytics.session import cut


def joined(rows):
    """Arrays of each key with its parts end to end."""
    found = {}
    for r in sorted(rows, key=lambda r: (r.k, r.part)):
        found.setdefault(r.k, []).extend(r.a)
    return found


def test_parts_end_to_end_are_the_array(spark):
    # key 1 has 300 rows far apart, key 2 has 300 copies of one row and some NULL values, key 3 is small, key 4 has a NULL place
    rows = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") * 40_000 - 3_000_000).alias("o"), F.col("id").cast("string").alias("v"))
    rows = rows.unionByName(spark.range(300).select(F.lit(2).alias("k"), F.lit(7).cast("long").alias("o"), F.lit("x").alias("v")))
    rows = rows.unionByName(spark.range(5).select(F.lit(2).alias("k"), F.lit(8).cast("long").alias("o"), F.lit(None).cast("string").alias("v")))
    rows = rows.unionByName(spark.range(4).select(F.lit(3).alias("k"), (10 - F.col("id")).alias("o"), F.col("id").cast("string").alias("v")))
    rows = rows.unionByName(spark.range(3).select(F.lit(4).alias("k"), F.when(F.col("id") > 0, -F.col("id")).alias("o"), F.col("id").cast("string").alias("v")))
    split = nest.gather(rows, "k", ["o"], F.col("v"), "a", array_rows=20).collect()
    whole = nest.gather(rows, "k", ["o"], F.col("v"), "a").collect()
    assert {r.part for r in whole} == {0} and len(whole) == 4
    assert joined(split) == {r.k: r.a for r in whole}
    assert joined(split)[1] == [str(i) for i in range(300)]
    assert joined(split)[2] == ["x"] * 300 + [None] * 5
    assert joined(split)[3] == ["3", "2", "1", "0"] and joined(split)[4] == ["0", "2", "1"]
    assert all(len(r.a) == 20 for r in split if r.k == 1) and max(len(r.a) for r in split) == 20


@pytest.mark.parametrize("null_places", [False, True])
def test_a_busy_key_spreads_over_ranges(spark, monkeypatch, null_places):
    """One order of 60,000 items over 29 documents beside many small ones: no range holds it, and its array is whole and in order."""
    sizes = []

    def seen(rows, order):
        out = ranged(rows, order)
        sizes.extend(r["count"] for r in out.filter("k = 1").groupBy("_piece").count().collect())
        return out

    monkeypatch.setattr(nest, "ranged", seen)
    part = F.lit(None).cast("long") if null_places else F.col("id") % 29
    hot = spark.range(60_000).select(F.lit(1).alias("k"), part.alias("part_no"), F.col("id").alias("pos"))
    cold = spark.range(30_000).select((F.col("id") % 10_000 + 2).cast("int").alias("k"), F.lit(0).cast("long").alias("part_no"), F.col("id").alias("pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nest.gather(hot.unionByName(cold), "k", ["part_no", "pos"], F.col("pos"), "a", array_rows=7_000).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 3 and max(sizes) < 30_000
    key = (lambda i: i) if null_places else (lambda i: (i % 29, i))
    assert joined(got)[1] == sorted(range(60_000), key=key)
    assert [len(r.a) for r in sorted((r for r in got if r.k == 1), key=lambda r: r.part)] == [7_000] * 8 + [4_000]
    assert sum(len(r.a) for r in got if r.k > 1) == 30_000


def test_nested_details_keep_everything_when_split(tables):
    args = (tables.request_masters, tables.requests, tables.approvals, tables.users, tables.addresses)

    def flat(array_rows):
        shape = (
            "array<struct<request_id:long,image:string,approvals:array<struct<approved_size:string,approved_color:string,"
            "approved_price:string,approval_id:long>>>>"
        )
        detail = Q.request_detail(*args, array_rows=array_rows)
        inner = detail.select("request_master_id", "part", F.explode(F.from_json("product_requests", shape)).alias("r"))
        return inner.select("request_master_id", "part", "r.*")

    whole, split = flat(1_000), flat(6)
    assert split.agg(F.max("part")).first()[0] > 0
    assert split.agg(F.max(F.size("approvals"))).first()[0] <= 6
    options = lambda d: Counter(
        d.select("request_master_id", "request_id", "image", F.explode_outer("approvals").alias("a")).select(
            "request_master_id", "request_id", "image", "a.*").collect()
    )
    assert options(split) == options(whole)


def test_blocked_lists_keep_everything_when_split(frame):
    items = frame(
        "order_id long,part int,pos int,is_custom_product boolean,product_id long,product_request_id long",
        *[(1, 0, i, True, None, 100 + i) for i in range(50)], (2, 0, 0, True, None, 100),
    )
    requests = frame("request_id long,product_name string,request_master_id long", (100, "first", 1))
    approvals = frame("request_id long", (999,))
    rows = gate_items(items, requests, approvals, array_rows=8)[1].collect()
    parts = sorted((r for r in rows if r.order_id == 1), key=lambda r: r.part)
    names = [n for r in parts for n in r.blocked_products.split(", ")]
    assert names == [str(100 + i) for i in range(49, 0, -1)] + ["first"] and len(parts) == 7
    assert [r.blocked_products for r in rows if r.order_id == 2] == ["first"]


def greedy(rows, hours):
    kept, last = set(), {}
    for url, at in sorted(rows):
        if url not in last or (at - last[url]).total_seconds() >= hours * 3600:
            kept.add((url, at))
            last[url] = at
    return kept


@pytest.mark.parametrize("hours", [24, 5])
def test_refresh_equals_brute_force(tables, hours):
    asked = tables.url_requests.filter("at < '2024-01-06'")
    assert {tuple(r) for r in refresh_due(asked, hours).collect()} == greedy([tuple(r) for r in asked.collect()], hours)


def test_refresh_of_one_url(frame):
    hours = ["2024-01-01 00:00:00", "2024-01-01 23:59:00", "2024-01-02 00:00:00", "2024-01-02 06:00:00",
             "2024-01-03 00:00:00", "2024-01-03 06:00:00", "2024-01-03 00:00:00"]
    asked = frame("url string,at timestamp_ntz", *[("u", h) for h in hours])
    kept = sorted(str(r.at) for r in refresh_due(asked).collect())
    assert kept == ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]


def test_refresh_of_a_busy_url_spans_tasks_and_few_rounds(spark, monkeypatch):
    """A third of all requests for one URL: its rows lie in many ranges, and rounds grow with the logarithm of its chain."""
    from storelytics.operators import refresh

    sizes, rounds = [], []

    def seen(rows, order):
        out = ranged(rows, order)
        sizes.extend(r["count"] for r in out.filter("url = 'hot'").groupBy("_piece").count().collect())
        return out

    monkeypatch.setattr(refresh, "ranged", seen)
    monkeypatch.setattr(refresh, "cut", lambda df: rounds.append(1) or cut(df))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    hot = spark.range(20_000).select(F.lit("hot").alias("url"), (start + F.make_dt_interval(mins=F.col("id").cast("int") * 7)).alias("at"))
    cold = spark.range(40_000).select(F.concat(F.lit("u"), F.col("id") % 9_000).alias("url"), (start + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"))
    asked = cut(hot.unionByName(cold))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in refresh_due(asked).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == greedy([tuple(r) for r in asked.collect()], 24)
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)
    assert len(rounds) <= 10


def test_refresh_respects_what_was_kept_before(frame):
    asked = frame("url string,at timestamp_ntz", ("u", "2024-01-01 05:00:00"), ("u", "2024-01-01 11:00:00"), ("v", "2024-01-01 01:00:00"))
    since = frame("url string,next_at timestamp_ntz", ("u", "2024-01-01 10:00:00"))
    assert {(r.url, r.at.hour) for r in refresh_due(asked, since=since).collect()} == {("u", 11), ("v", 1)}


def test_dense_ids_have_no_gaps(spark):
    rows = spark.range(1_000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    numbered = dense_ids(rows, "n", ["x", "id"], 100)
    got = [(r.x, r.id) for r in numbered.orderBy("n").collect()]
    assert got == sorted(got)
    assert [r.n for r in numbered.orderBy("n").collect()] == list(range(101, 1_101))
    assert dense_ids(rows.limit(0), "n", ["x", "id"]).count() == 0
