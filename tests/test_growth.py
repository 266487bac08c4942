"""Plans and results that keep what a query costs in step with its input."""

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelytics.functions import nest, ordered
from storelytics.operators import accounts as A
from storelytics.operators import customers as C
from storelytics.operators import intake as I
from storelytics.operators.preview import scan


@pytest.fixture
def unbroadcast(spark):
    """Joins as large tables get them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_collated_keys_are_looked_up_not_sorted(frame, unbroadcast):
    users = frame(
        "user_id long,email string,phone string,role string,delete_status boolean",
        (1, "zoe@x", "1", "customer", False), (2, "ZOË@x", None, "admin", False), (3, None, "3", "customer", False),
    )
    probes = frame(
        "probe_id long,login_type string,value string",
        (1, "email", "Zoé@X"), (2, "phone", "3"), (3, "email", None), *[(10 + i, "email", "nobody") for i in range(200)],
    )
    found = C.lookup_users(users, probes)
    assert "[collationkey" not in "".join(x for x in plan(found).splitlines() if "Sort" in x)
    assert sorted((r.probe_id, r.user_id) for r in found.collect()) == [(1, 1), (1, 2), (2, 3)]
    new = frame("signup_id long,email string", (1, "ZOE@X"), (2, "new@x"), (3, "NEW@x"), (4, None), (5, None))
    kept, rejects = A.insert_users(users.withColumn("created_at", F.lit(None).cast("timestamp_ntz")), new, datetime(2024, 1, 1))
    assert "[collationkey" not in "".join(x for x in plan(rejects).splitlines() if "Sort" in x)
    assert sorted(r.signup_id for r in rejects.collect()) == [1, 3]
    assert sorted(r.user_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6]


ITEMS = "order_id long,part int,pos int,is_custom_product boolean,product_id long,product_request_id long"


def test_documents_are_parsed_once(frame):
    batch = frame(
        "order_id long,part int,user_id long,address_id long,subtotal double,service_charge double,delivery_charge double,total double,items string",
        *[(i, 0, 1, 1, 1.0, 0.0, 0.0, 1.0, text) for i, text in enumerate(['[{"quantity":2},null,{"quantity":"3"}]', "[]", None, "oops"])],
    )
    items = I.ingest_orders(batch, datetime(2024, 1, 1))["items"]
    assert plan(items).count("from_json") == 1
    assert sorted((r.order_id, r.pos, r.quantity) for r in items.collect() if r.pos != 1) == [(0, 0, 2), (0, 2, 3)]
    assert items.filter("pos = 1 AND quantity IS NULL").count() == 1


def test_items_without_a_request_are_no_join_key(frame):
    items = frame(
        ITEMS, (1, 0, 0, False, 5, None), (1, 0, 1, True, None, 7), (1, 0, 2, True, None, 8), (1, 0, 3, True, None, None),
        (2, 0, 0, None, None, 7), (2, 0, 1, None, None, 8), (2, 0, 2, None, None, None), (2, 0, 3, False, 5, 8), (3, 0, 0, True, None, 9),
    )
    requests = frame("request_id long,product_name string", (8, "eight"), (None, "none"), (9, None))
    approvals = frame("request_id long", (7,), (7,), (None,))
    passed, blocked = I.gate_items(items, requests, approvals)
    assert "LeftOuter" not in plan(passed)
    assert sorted((r.order_id, r.pos) for r in passed.collect()) == [(1, 0), (1, 1), (2, 0), (2, 3)]
    assert sorted((r.order_id, r.part, r.blocked_products) for r in blocked.collect()) == [(1, 0, "eight"), (3, 0, "9")]


def test_only_busy_keys_are_laid_out_by_ranges(spark, monkeypatch):
    laid = []
    monkeypatch.setattr(nest, "ranged", lambda rows, order: laid.append(rows.select("k").distinct().collect()) or ordered.ranged(rows, order))
    rows = spark.range(3_000).select((F.col("id") % 100).alias("k"), (-F.col("id")).alias("o"), F.struct(F.col("id").alias("v")).alias("v"))
    light = nest.gather(rows, "k", ["o"], F.col("v"), "a")
    assert not laid and "Window" not in plan(light)
    whole = {r.k: [x.v for x in r.a] for r in light.collect()}
    assert whole == {k: sorted(range(k, 3_000, 100), reverse=True) for k in range(100)}
    # key 0 is too heavy for one part, key 1 weighs exactly what a part holds, and a last row without weight is a part of its own
    weight = F.when(F.col("k") == 0, 100).when((F.col("k") == 1) & (F.col("o") != -1), 100).when(F.col("k") == 1, 0).otherwise(1)
    parts = nest.gather(rows, "k", ["o"], F.col("v"), "a", 2_900, weight).collect()
    assert [sorted(r.k for r in found) for found in laid] == [[0, 1]]
    got = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part)):
        got.setdefault(r.k, []).append([x.v for x in r.a])
    assert [len(a) for a in got[0]] == [29, 1] and [len(a) for a in got[1]] == [29, 1] and all(len(got[k]) == 1 for k in range(2, 100))
    assert {k: sum(a, []) for k, a in got.items()} == whole


def test_pages_are_scanned_in_small_steps(monkeypatch):
    pages = ["<title>a</title><p class='x'>b</p>", None, "", "<h1>" + "c" * 500 + "</h1>", "<img src='d'>"] * 40
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "url": ["u"] * 200, "html": pages})
    whole = pa.Table.from_batches(scan._scan_batches(iter([batch])))
    monkeypatch.setattr(scan, "STEP_CHARS", 1_000)
    steps = list(scan._scan_batches(iter([batch, batch.slice(0, 0)])))
    assert max(len(step) for step in steps) <= 10 and len(steps) >= 20
    assert pa.Table.from_batches(steps).to_pylist() == whole.to_pylist()
    assert whole.num_rows == 200 and [len(x) for x in whole["elements"].to_pylist()[:5]] == [2, 0, 0, 1, 1]
