import json

import pytest
from pyspark.sql import functions as F

from storelytics.functions import nest
from storelytics.functions.ordered import ranged
from storelytics.operators import customers as C
from storelytics.operators import orders as O
from storelytics.operators import requests as Q
from storelytics.schemas import order_status


@pytest.fixture
def shop(frame, spark):
    return {
        "orders": frame(
            "order_id long,user_id long,address_id long,status string,order_status_id int,scheduled_time string,"
            "subtotal decimal(12,2),service_charge decimal(12,2),delivery_charge decimal(12,2),total decimal(12,2),"
            "created_at timestamp_ntz,delete_status boolean",
            *[(i, 1, 9, "Pending", code, None, "1.00", "0.00", "0.00", "1.00", f"2024-01-0{i} 00:00:00", gone)
              for i, code, gone in ((1, 3, False), (2, 1, False), (3, 3, True), (4, None, False))],
        ),
        "items": frame(
            "order_item_id long,order_id long,is_custom_product boolean,product_id long,product_request_id long,"
            "approval_id long,quantity int,price decimal(12,2),delete_status boolean",
            (12, 1, True, 5, 7, 70, 2, "3.50", False), (11, 1, False, 5, 7, None, 1, "9.99", True),
            (13, 1, False, 6, None, None, 1, "1.00", False),
        ),
        "products": frame(
            "product_id long,name string,image string,category string,price decimal(12,2)",
            (5, "cup", "cup.png", "kitchen", "9.90"), (6, "pot", None, "kitchen", "1.00"),
        ),
        "requests": frame(
            "request_id long,request_master_id long,product_name string,description string,requested_size string,"
            "requested_color string,image string,status string,request_status_id int,delete_status boolean",
            (7, 70, "shirt", None, "M", None, "shirt.png", "Approved", 2, False),
        ),
        "masters": frame("request_master_id long,user_id long,status string", (70, 1, "Completed")),
        "approvals": frame(
            "approval_id long,approved_by long,approved_size string,approved_color string,approved_price decimal(12,2)",
            (70, 2, "L", "red", "3.5"),
        ),
        "users": frame("user_id long,name string", (1, "Ann")),
        "addresses": frame("address_id long,address_line string,city string,state string,zip_code string,country string"),
        "order_status": order_status(spark),
    }


def pick(shop, *names):
    return [shop[n] for n in names]


ALL = ("orders", "items", "products", "requests", "users", "addresses", "order_status")


def test_images_cover_deleted_items_keep_nulls_and_order(shop):
    rows = {r.order_id: json.loads(r.order_images) for r in O.order_listing(*pick(shop, *ALL)).collect()}
    assert rows == {1: ["cup.png", "shirt.png", None], 2: [], 4: []}


def test_listing_filters_on_the_status_id(shop):
    rows = O.order_listing(*pick(shop, *ALL), status="Shipped").collect()
    assert [(r.order_id, r.status, r.order_status) for r in rows] == [(1, "Pending", "Shipped")]


@pytest.mark.parametrize("limit", [2, 5_000])
def test_listing_pages_newest_first(shop, limit):
    rows = O.order_listing(*pick(shop, *ALL), limit=limit, offset=1).collect()
    assert [r.order_id for r in rows] == [2, 1]


def test_details_leave_out_deleted_items_and_split_by_kind(shop):
    rows = O.order_item_details(*pick(shop, "items", "products", "requests", "masters", "approvals"), ids=[1]).collect()
    detail = {r.order_item_id: json.loads(r.product_details) for r in rows}
    assert set(detail) == {12, 13}
    assert len(detail[12]) == 13 and len(detail[13]) == 4
    assert (detail[12]["user_id"], detail[12]["status"], detail[12]["approved_price"]) == (1, "Completed", "3.50")
    assert detail[12]["description"] is None
    assert detail[13] == {"product_id": 6, "name": "pot", "category": "kitchen", "price": "1.00"}
    assert {r.order_item_id: str(r.item_subtotal) for r in rows} == {12: "7.00", 13: "1.00"}


def test_user_orders_by_id_list_and_by_table(shop, frame):
    names = ("orders", "items", "products", "requests", "addresses", "order_status")
    listed = O.user_orders(*pick(shop, *names), ids=[1]).collect()
    keyed = O.user_orders(*pick(shop, *names), ids=frame("id long", (1,))).collect()
    assert listed == keyed and [r.order_id for r in listed] == [4, 2, 1]
    assert O.user_orders(*pick(shop, *names), statuses=["Shipped"]).count() == 1


def test_customer_search(frame):
    users = frame(
        "user_id long,name string,email string,phone string,role string",
        (1, "José", None, "1", "customer"), (2, "JOSE", None, "2", "customer"), (3, "100%", "x@y", None, "customer"),
        (4, "a_b", None, None, "customer"), (5, "axb", None, None, "customer"), (6, "jose", None, None, "admin"),
    )
    count = lambda *a, **k: C.customer_count(users, *a, **k).first().total
    assert count() == 5
    assert count("jose") == 1
    assert count("jose", ignore_accents=True) == 2
    assert count("a_b") == 2  # a wildcard in the plain form
    assert count("a_b", ignore_accents=True) == 1
    assert count("X@Y") == 1


def test_count_equals_unpaged_ranking(tables):
    ranked = C.customers_ranked(tables.users, tables.orders, "r#0000", limit=10_000)
    assert ranked.count() == C.customer_count(tables.users, "r#0000").first().total


def test_customers_without_orders(frame):
    users = frame("user_id long,name string,email string,phone string,role string,password string", (1, "a", None, None, "customer", "x"))
    orders = frame("user_id long,total decimal(12,2)")
    assert C.customer_stats(users, orders).first().asDict()["total_spent"] is None
    ranked = C.customers_ranked(users, orders).first()
    assert (ranked.total_orders, ranked.total_spent) == (0, 0)
    assert "password" not in C.user_profile(users).columns + C.customer_stats(users, orders).columns


@pytest.fixture
def asked(frame):
    masters = frame(
        "request_master_id long,user_id long,address_id long,status string,delivery_date string,created_at timestamp_ntz,"
        "delete_status boolean",
        (1, 1, 1, "Pending", None, None, False), (2, 1, 1, "Pending", None, None, False), (3, 1, 1, "Pending", None, None, True),
        (4, 2, 1, "Pending", None, None, False),
    )
    requests = frame(
        "request_id long,request_master_id long,product_name string,description string,requested_size string,"
        "requested_color string,image string,status string,request_status_id int,delete_status boolean",
        (10, 1, "a", None, None, None, None, "Pending", 1, False), (11, 1, "b", None, None, None, "b.png", "Rejected", 3, True),
        (12, 4, "c", None, None, None, "c.png", "Approved", 2, False),
    )
    approvals = frame(
        "approval_id long,request_id long,approved_size string,approved_color string,approved_price decimal(12,2)",
        (2, 12, "M", "red", "2.5"), (1, 12, "S", None, "1.25"),
    )
    users = frame("user_id long,name string,email string", (1, "Ann", "a@x"), (2, "Bo", None))
    addresses = frame("address_id long,address_line string,city string,state string,zip_code string,country string", (1, "l", "c", None, "z", "n"))
    return masters, requests, approvals, users, addresses


def test_request_lists(asked):
    masters, requests, _, users, addresses = asked
    rows = Q.request_list(masters, requests, users, addresses).collect()
    assert [(r.request_master_id, r.product_images) for r in rows] == [(4, '["c.png"]'), (2, "[]"), (1, "[null]")]
    # a deleted request still decides by its status, yet its image is not shown
    rows = Q.request_list(masters, requests, users, addresses, status="Rejected").collect()
    assert [(r.request_master_id, r.product_images) for r in rows] == [(1, "[null]")]
    # the customer's list leaves out masters without requests
    rows = Q.customer_request_list(masters, requests, addresses, ids=[1]).collect()
    assert [r.request_master_id for r in rows] == [1]
    assert "master_created_at" in rows[0].asDict()


def test_request_details(asked):
    rows = {r.request_master_id: json.loads(r.product_requests) for r in Q.request_detail(*asked).collect()}
    assert set(rows) == {1, 2, 4} and rows[2] == []
    assert [(q["request_id"], q["approvals"]) for q in rows[1]] == [(10, None)]
    assert [(a["approval_id"], a["approved_price"], a["approved_color"]) for a in rows[4][0]["approvals"]] == [(1, "1.25", None), (2, "2.50", "red")]
    assert Q.request_detail(*asked, ids=[4]).count() == 1
    assert Q.customer_request_detail(*asked, user_ids=[1], ids=[4]).count() == 0
    assert Q.customer_request_detail(*asked, user_ids=[2], ids=[4]).count() == 1
    assert Q.request_detail(*asked, ids=[]).count() == 0


def test_recent_orders_count_items(tables):
    rows = O.recent_orders(tables.orders, tables.order_items, n=3)
    assert rows.groupBy("user_id").count().agg(F.max("count")).first()[0] == 3
    assert rows.filter("item_count IS NULL").count() == 0


def test_search_takes_a_backslash_literally(frame):
    users = frame("user_id long,name string,email string,phone string,role string", (1, "a\\b", None, None, "customer"), (2, "ab", None, None, "customer"))
    assert C.customer_count(users, "A\\b").first().total == 1
    assert C.customer_count(users, "a%").first().total == 2


def test_envelope_cuts_and_keeps_the_order(frame):
    rows = frame("id long,day string", *[(i, f"d{i % 3}") for i in range(9)])
    total = frame("total_amount string", ("5",))
    record = json.loads(O.envelope(rows, total, "orders", [F.desc("day"), F.asc("id")], "ok", limit=4, offset=1).first().response)
    assert [r["id"] for r in record["data"]["orders"]] == [5, 8, 1, 4]


def test_narrow_listings_read_only_what_they_show(tables, monkeypatch):
    """Counted over all plans of a listing: its own and those of the rows it lays out by ranges on the way."""
    laid = []
    monkeypatch.setattr(nest, "ranged", lambda rows, order: laid.append(rows) or ranged(rows, order))
    some = tables.users.filter("user_id = 7").select("user_id")
    for listing in (
        lambda: Q.customer_request_list(tables.request_masters, tables.requests, tables.addresses, ids=some),
        lambda: O.recent_orders(tables.orders, tables.order_items, ids=some),
        lambda: Q.request_list(tables.request_masters, tables.requests, tables.users, tables.addresses, status="Rejected"),
    ):
        laid.clear()
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [listing(), *laid]]
        assert sum(p.count("LeftSemi") for p in plans) >= 2
