"""Listings of product requests: a master holds requests, a request holds approved options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.nest import ARRAY_ROWS, as_json, attach, gather
from storelytics.functions.predicates import having_ids

ADDRESS = ["address_line", "city", "state", "zip_code", "country"]
KEY = "request_master_id"


def _with_status(masters, requests, status) -> DataFrame:
    """Undeleted masters; with a status, those where any request, deleted or not, has it."""
    kept = masters.filter(~F.col("delete_status"))
    if status is None:
        return kept
    return kept.join(requests.filter(F.col("status") == status).select(KEY).distinct(), KEY, "left_semi")


def _placed(masters, addresses) -> DataFrame:
    return masters.join(addresses.select("address_id", *ADDRESS), "address_id", "left")


def _customer(masters, users) -> DataFrame:
    named = users.select("user_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"))
    return masters.join(named, "user_id", "left")


def _with_images(masters, requests, array_rows, narrowed: bool) -> DataFrame:
    """Masters with the images of their undeleted requests; ``narrowed`` spares the requests of other masters."""
    shown = requests.filter(~F.col("delete_status")).select(KEY, "request_id", "image")
    if narrowed:
        shown = shown.join(masters.select(KEY), KEY, "left_semi")
    images = gather(shown, KEY, ["request_id"], F.col("image"), "product_images", array_rows)
    return attach(masters, images, KEY, "product_images").withColumn("product_images", as_json("product_images"))


def request_list(masters, requests, users, addresses, status=None, array_rows=ARRAY_ROWS) -> DataFrame:
    """All masters with the images of their undeleted requests, newest first."""
    kept = _placed(_customer(_with_status(masters, requests, status), users), addresses)
    return (
        _with_images(kept, requests, array_rows, narrowed=status is not None)
        .select(
            KEY, "part", F.col("status").alias("master_status"), "delivery_date",
            "customer_name", "customer_email", *ADDRESS, "address_id", "product_images",
        )
        .orderBy(F.desc(KEY), "part")
    )


def customer_request_list(masters, requests, addresses, ids=None, status=None, array_rows=ARRAY_ROWS) -> DataFrame:
    """As ``request_list`` for the given customers, but a master without any request is left out."""
    own = having_ids(masters, "user_id", ids)
    kept = _with_status(own, requests, status).join(requests.select(KEY).distinct(), KEY, "left_semi")
    return (
        _with_images(_placed(kept, addresses), requests, array_rows, narrowed=ids is not None or status is not None)
        .select(
            "user_id", KEY, "part", F.col("status").alias("master_status"), F.col("created_at").alias("master_created_at"),
            "delivery_date", *ADDRESS, "product_images",
        )
        .orderBy(F.desc(KEY), "part")
    )


def _nested(masters, requests, approvals, array_rows) -> DataFrame:
    """Masters with ``product_requests``: undeleted requests, each with its approvals or null.

    Both levels respect the array limit: a request with very many approvals fills several entries, and a
    master is split by the number of approvals it holds, not only by its requests.
    """
    option = F.struct(
        "approved_size", "approved_color", F.col("approved_price").cast("string").alias("approved_price"), "approval_id"
    )
    order = ["approval_id", "approved_size", "approved_color", "approved_price"]
    options = gather(approvals, "request_id", order, option, "approvals", array_rows)
    shown = requests.filter(~F.col("delete_status"))
    full = attach(shown, options, "request_id", "approvals", empty=False).withColumnRenamed("part", "option_part")
    entry = F.struct(
        "request_id", "product_name", "description", "requested_size", "requested_color",
        "status", "request_status_id", "image", "approvals",
    )
    size = F.greatest(F.size("approvals"), F.lit(1))
    arrays = gather(full, KEY, ["request_id", "option_part"], entry, "product_requests", array_rows, size)
    return attach(masters, arrays, KEY, "product_requests").withColumn("product_requests", as_json("product_requests"))


def _detail(kept, requests, approvals, users, addresses, array_rows) -> DataFrame:
    placed = _placed(_customer(kept, users), addresses)
    return _nested(placed, requests, approvals, array_rows).select(
        "user_id", KEY, "part", F.col("status").alias("master_status"), F.col("created_at").alias("master_created_at"),
        "customer_name", "customer_email", *ADDRESS, "address_id", "delivery_date", "product_requests",
    )


def _children(kept, requests, approvals, narrowed: bool):
    """Requests and approvals below the kept masters; no join where every master is kept."""
    if not narrowed:
        return requests, approvals
    requests = requests.join(kept.select(KEY), KEY, "left_semi")
    return requests, approvals.join(requests.select("request_id"), "request_id", "left_semi")


def request_detail(
    masters, requests, approvals, users, addresses, ids=None, status=None, array_rows=ARRAY_ROWS
) -> DataFrame:
    """Masters with their requests and approvals; a status keeps masters with such a request."""
    kept = _with_status(having_ids(masters, KEY, ids), requests, status)
    below = _children(kept, requests, approvals, narrowed=ids is not None or status is not None)
    return _detail(kept, *below, users, addresses, array_rows)


def customer_request_detail(
    masters, requests, approvals, users, addresses, user_ids=None, ids=None, status=None, array_rows=ARRAY_ROWS
) -> DataFrame:
    """``request_detail`` for masters that belong to the given users."""
    own = having_ids(masters, "user_id", user_ids)
    kept = _with_status(having_ids(own, KEY, ids), requests, status)
    below = _children(kept, requests, approvals, narrowed=any(x is not None for x in (ids, user_ids, status)))
    return _detail(kept, *below, users, addresses, array_rows)
