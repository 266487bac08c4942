"""Order listings, details and history.

Every function takes ``ids=None`` for all keys in one job. Arrays come as JSON text with a ``part`` column: a key with
more children than ``array_rows`` has several parts, whose arrays joined in order are the whole (see ``functions.nest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelytics.functions.nest import ARRAY_ROWS, as_json, attach, gather
from storelytics.functions.predicates import equals, having_ids, page, within
from storelytics.session import cut

ADDRESS = ["address_line", "city", "state", "zip_code", "country"]
CHARGES = ["subtotal", "service_charge", "delivery_charge", "total"]


def with_subtotal(items: DataFrame) -> DataFrame:
    """Add the line amount, quantity times price."""
    return items.withColumn("subtotal", (F.col("quantity") * F.col("price")).cast("decimal(20,2)"))


def order_images(items, products, requests, array_rows=ARRAY_ROWS) -> DataFrame:
    """(order_id, part, order_images): one image per item, deleted items included and missing images kept.

    An item needs one lookup only, by its kind, so the kinds take separate joins: each item is moved once, and
    the empty reference of the other kind is no join key that half the table would share.
    """
    place = ["order_id", "order_item_id", "image"]
    custom = F.coalesce("is_custom_product", F.lit(False))
    stocked = items.filter(~custom).join(products.select("product_id", "image"), "product_id", "left")
    images = requests.select(F.col("request_id").alias("product_request_id"), "image")
    made = items.filter(custom).join(images, "product_request_id", "left")
    shown = stocked.select(*place).unionByName(made.select(*place))
    return gather(shown, "order_id", ["order_item_id"], F.col("image"), "order_images", array_rows)


def _headers(orders: DataFrame, order_status: DataFrame) -> DataFrame:
    """Undeleted orders with the name their status id stands for (which may differ from ``status``)."""
    names = order_status.select("order_status_id", F.col("status_name").alias("order_status"))
    return orders.filter(~F.col("delete_status")).join(names, "order_status_id", "left")


def _with_images(headers, items, products, requests, array_rows, only: DataFrame | None = None) -> DataFrame:
    """Headers with images; ``only`` (order_id) spares the lookups for items of other orders."""
    wanted = items if only is None else items.join(only.select("order_id"), "order_id", "left_semi")
    images = order_images(wanted, products, requests, array_rows)
    return attach(headers, images, "order_id", "order_images").withColumn("order_images", as_json("order_images"))


def order_listing(
    orders, items, products, requests, users, addresses, order_status,
    status=None, start=None, end=None, limit=10, offset=0, array_rows=ARRAY_ROWS,
) -> DataFrame:
    """One page of orders, newest first, with customer, address and images.

    The page is cut from the order headers and written first, so names, addresses and images are looked up only for the
    orders on it and it is ranked once.
    """
    shown = equals(_headers(within(orders, "created_at", start, end), order_status), "order_status", status)
    paged = cut(page(shown, [F.desc("created_at"), F.asc("order_id")], limit, offset))
    full = paged.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left").join(
        addresses.select("address_id", *ADDRESS), "address_id", "left"
    )
    return (
        _with_images(full, items, products, requests, array_rows, only=paged)
        .select(
            "order_id", "part", "user_id", "user_name", "address_id", *ADDRESS, *CHARGES,
            "status", "order_status", "scheduled_time", "created_at", "order_images",
        )
        .orderBy(F.desc("created_at"), "order_id", "part")
    )


def user_orders(
    orders, items, products, requests, addresses, order_status, ids=None, statuses=None, array_rows=ARRAY_ROWS
) -> DataFrame:
    """Undeleted orders of the given users, or of all, with address and images; optionally only some statuses.

    Newest first for given users. The job over all users leaves the order to its reader: sorting the images of
    every order would move them once more for nothing.
    """
    shown = _headers(having_ids(orders, "user_id", ids), order_status)
    if statuses is not None:
        shown = shown.filter(F.col("order_status").isin(list(statuses)))
    placed = shown.join(addresses.select("address_id", *ADDRESS), "address_id", "left")
    only = None if ids is None and statuses is None else shown
    placed = _with_images(placed, items, products, requests, array_rows, only)
    rows = placed.select(
        "user_id", "order_id", "part", "address_id", *ADDRESS, *CHARGES,
        "scheduled_time", "status", "order_status", "created_at", "order_images",
    )
    return rows if ids is None else rows.orderBy(F.desc("created_at"), "order_id", "part")


def order_header(orders, order_status, ids=None) -> DataFrame:
    return _headers(having_ids(orders, "order_id", ids), order_status).select(
        "order_id", "user_id", "address_id", *CHARGES, "status", "order_status", "scheduled_time", "created_at"
    )


def _money_text(column: str) -> Column:
    return F.col(column).cast("string")


def order_item_details(items, products, requests, masters, approvals, ids=None) -> DataFrame:
    """Undeleted items, each with a JSON object whose shape depends on the kind of item.

    Custom items look up their request, its master and the chosen approval; the others their product. An
    item's other reference never pulls in a row.
    """
    rows = with_subtotal(having_ids(items, "order_id", ids).filter(~F.col("delete_status")))
    rows = rows.withColumn("_custom", F.coalesce("is_custom_product", F.lit(False)))
    owner = masters.select("request_master_id", F.col("user_id").alias("_owner"), F.col("status").alias("_owner_status"))
    option = approvals.select("approval_id", "approved_by", "approved_size", "approved_color", "approved_price")
    asked = requests.select(
        "request_id", "request_master_id", "product_name", "description", "requested_size", "requested_color", "image"
    )
    made = (
        rows.filter("_custom")
        .join(asked.withColumn("product_request_id", F.col("request_id")), "product_request_id", "left")
        .join(owner, "request_master_id", "left")
        .join(option.withColumn("_option", F.col("approval_id")), "approval_id", "left")
    )
    made_detail = F.struct(
        "request_id", F.col("_owner").alias("user_id"), "product_name", "description", "requested_size",
        "requested_color", F.col("_owner_status").alias("status"), "image", F.col("_option").alias("approval_id"),
        "approved_by", "approved_size", "approved_color", _money_text("approved_price").alias("approved_price"),
    )
    goods = products.select(
        F.col("product_id").alias("_product"), "name", "category", _money_text("price").alias("_price")
    )
    # A kind that is not stated is no stocked product either: its lookup key is empty.
    wanted = F.when(~F.col("is_custom_product"), F.col("product_id"))
    stocked = rows.filter("NOT _custom").withColumn("_wanted", wanted).join(goods, F.col("_wanted") == F.col("_product"), "left")
    stocked_detail = F.struct(F.col("_product").alias("product_id"), "name", "category", F.col("_price").alias("price"))

    def shown(kind, detail):
        return kind.select(
            "order_id", "order_item_id", "product_id", F.col("is_custom_product").cast("int").alias("is_custom_product"),
            "product_request_id", "quantity", "price", F.col("subtotal").alias("item_subtotal"),
            as_json(detail).alias("product_details"),
        )

    return shown(made, made_detail).unionByName(shown(stocked, stocked_detail))


def order_history(history, orders, users, ids=None) -> DataFrame:
    """Status changes of orders, in time order, with the customer."""
    placed = orders.select("order_id", "user_id", "scheduled_time").join(
        users.select("user_id", F.col("name").alias("customer_name")), "user_id", "left"
    )
    steps = having_ids(history, "order_id", ids).select(
        "history_id", "order_id", "status", "order_status_id", "updated_at"
    )
    return steps.join(placed, "order_id").orderBy("order_id", "updated_at", "history_id")


def recent_orders(orders, items, ids=None, n=10) -> DataFrame:
    """The ``n`` latest orders of each customer with their item counts.

    ``rank <= n`` lets Spark cut each customer to ``n`` rows before the shuffle, so a customer with a
    third of all orders is no hot spot.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("order_id"))
    latest = (
        having_ids(orders, "user_id", ids)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )
    # Only the items of the orders shown are counted; for all customers that is most of them.
    counted = items if ids is None else items.join(latest.select("order_id"), "order_id", "left_semi")
    counts = counted.groupBy("order_id").agg(F.count("order_item_id").alias("item_count"))
    rows = latest.join(counts, "order_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return rows if ids is None else rows.orderBy("user_id", F.desc("created_at"), "order_id")


def envelope(rows: DataFrame, total: DataFrame, name: str, order: list, message: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of ``rows`` in ``order`` and its total as one JSON record; no more rows than ``limit`` are gathered."""
    ranked = page(rows, order, limit, offset).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    entry = F.struct("_rank", F.struct(*rows.columns).alias("_value"))
    listed = ranked.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["_value"]).alias(name))
    data = F.struct(F.col(name), total.scalar().alias("total"))
    record = F.struct(F.lit(True).alias("success"), F.lit(message).alias("message"), data.alias("data"))
    return listed.select(as_json(record).alias("response"))
