"""Taking in batches of orders and product requests whose items arrive as JSON arrays.

A batch row is one document of an order or request master. ``part`` numbers the documents of one key;
an ordinary key has just part 0. Inside a document ``pos`` is the place in the array. Numbering of new
rows goes from the last item of an array to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.ids import dense_ids
from storelytics.functions.nest import ARRAY_ROWS, attach, gather, joined_text
from storelytics.functions.predicates import moment
from storelytics.operators.orders import with_subtotal
from storelytics.operators.upserts import overlay
from storelytics.schemas import ORDER_ITEMS_JSON, REQUEST_ITEMS_JSON
from storelytics.session import cut

PLACE = ["order_id", "part", "pos"]


def _parsed(batch: DataFrame, key: str, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The batch with its documents parsed into ``_items``, and the documents that are no JSON array.

    Such a document gives no items, its key stays. An absent document has no items either, and is no reject.
    """
    array = F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(text, schema))
    parsed = batch.withColumn("_items", array)
    bad = F.col(text).isNotNull() & F.col("_items").isNull()
    return parsed, parsed.filter(bad).select(key, "part", text, F.lit("Items are not a JSON array").alias("reason"))


def _exploded(parsed: DataFrame, *columns: str) -> DataFrame:
    """``columns``, pos and item of every entry of ``_items``.

    The plain ``posexplode`` lets Spark ask first whether the array is there and has entries, and both questions parse the document again.
    """
    return parsed.select(*columns, F.posexplode_outer("_items").alias("pos", "item")).filter(F.col("pos").isNotNull())


def _whole(field: str, kind: str) -> Column:
    """A whole number from its text; a fraction is rounded, anything else is NULL."""
    text = F.col(f"item.{field}")
    return F.coalesce(text.try_cast(kind), F.round(text.try_cast("decimal(30,6)")).try_cast(kind)).alias(field)


def ingest_orders(batch: DataFrame, now) -> dict[str, DataFrame]:
    """Orders, their items, the opening history row, and the documents that could not be read (``rejects``).

    ``batch``: order_id, part, user_id, address_id, subtotal, service_charge, delivery_charge, total, items. Numbers inside
    the documents may be quoted.
    """
    batch, rejects = _parsed(batch, "order_id", "items", ORDER_ITEMS_JSON)
    orders = batch.filter(F.col("part") == 0).select(
        "order_id", "user_id", "address_id", "subtotal", "service_charge", "delivery_charge", "total",
        F.lit("Pending").alias("status"), F.lit(1).alias("order_status_id"),
        F.lit(None).cast("string").alias("scheduled_time"), F.lit(False).alias("delete_status"),
        moment(now).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    parsed = _exploded(batch, "order_id", "part")
    custom = F.coalesce(_whole("is_custom_product", "int") == 1, F.lit(False))
    items = parsed.select(
        *PLACE,
        custom.alias("is_custom_product"),
        F.when(~custom, _whole("product_id", "bigint")).alias("product_id"),
        F.when(custom, _whole("product_request_id", "bigint")).alias("product_request_id"),
        _whole("approval_id", "bigint"),
        _whole("quantity", "int"),
        F.col("item.price").try_cast("decimal(12,2)").alias("price"),
    )
    history = orders.select("order_id", "status", F.col("created_at").alias("updated_at"))
    return {"orders": orders, "items": with_subtotal(items), "history": history, "rejects": rejects}


def gate_items(items, requests, approvals, array_rows=ARRAY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Split items into those that may be ordered and, per order, the names of those that may not.

    A custom item needs an approval of its request. A blocked request without a name is shown by its id.
    """
    approved = approvals.select(F.col("request_id").alias("product_request_id")).distinct()
    names = requests.select(F.col("request_id").alias("product_request_id"), "product_name")
    # Items without a request, among them all stocked ones, are no part of a join: its tasks would all be one.
    custom, asked = F.col("is_custom_product"), F.col("product_request_id").isNotNull()
    ours = items.filter((custom | custom.isNull()) & asked)
    passed = items.filter(~custom).unionByName(ours.join(approved, "product_request_id", "left_semi").select(*items.columns))
    refused = ours.filter(custom).join(approved, "product_request_id", "left_anti").join(names, "product_request_id", "left")
    nameless = items.filter(custom & ~asked).withColumn("product_name", F.lit(None).cast(names.schema["product_name"].dataType))
    stopped = refused.unionByName(nameless.select(*refused.columns)).select(
        "order_id", _back("part"), _back("pos"), F.coalesce("product_name", F.col("product_request_id").cast("string")).alias("label")
    )
    blocked = gather(stopped, "order_id", ["_part", "_pos"], F.col("label"), "labels", array_rows)
    names_of = joined_text("labels").alias("blocked_products")
    return passed, blocked.select("order_id", F.col("part").cast("int").alias("part"), names_of)


def _back(column: str):
    return (-F.col(column)).alias(f"_{column}")


def _ordered_requests(passed: DataFrame) -> DataFrame:
    return passed.filter(F.col("is_custom_product")).select(F.col("product_request_id").alias("request_id")).distinct()


def complete_requests(requests, masters, passed, now) -> tuple[DataFrame, DataFrame]:
    """Set ordered requests and their masters to Completed; status ids stay as they are."""
    done = {"status": F.lit("Completed"), "updated_at": moment(now)}
    ordered = _ordered_requests(passed)
    touched = requests.join(ordered, "request_id", "left_semi").select("request_master_id").distinct()
    return overlay(requests, ordered, ["request_id"], done), overlay(masters, touched, ["request_master_id"], done)


def order_audit(orders, passed, requests, now, array_rows=ARRAY_ROWS) -> DataFrame:
    """One log row per order: the request masters and requests it used, in order of processing."""
    custom = passed.filter(F.col("is_custom_product"))
    masters = requests.select(F.col("request_id").alias("product_request_id"), "request_master_id")
    used = custom.join(masters, "product_request_id", "left").select(
        "order_id", _back("part"), _back("pos"), "product_request_id", "request_master_id"
    )
    pair = F.struct("request_master_id", "product_request_id")
    pairs = gather(used, "order_id", ["_part", "_pos"], pair, "used", array_rows)
    log = attach(orders.select("order_id"), pairs, "order_id", "used")

    def listed(field):
        return F.array_join(F.transform("used", lambda u: u[field].cast("string")), ",")

    return log.select(
        "order_id", "part", listed("request_master_id").alias("affected_request_masters"),
        listed("product_request_id").alias("approved_requests"), moment(now).alias("created_at"),
    )


def schedule_from_request(orders, passed, requests, masters) -> DataFrame:
    """Set each new order's delivery date from the master of its first custom item."""
    first = passed.filter(F.col("is_custom_product")).groupBy("order_id").agg(
        F.min_by("product_request_id", F.struct("part", "pos")).alias("request_id")
    )
    dates = (
        first.join(requests.select("request_id", "request_master_id"), "request_id")
        .join(masters.select("request_master_id", "delivery_date"), "request_master_id")
        .select("order_id", "delivery_date")
    )
    return overlay(orders, dates, ["order_id"], {"scheduled_time": F.col("patch.delivery_date")})


def ingest_requests(batch: DataFrame, request_status: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Request masters and their requests, all Pending; ``unread_requests`` has the documents that could not be read.

    ``batch``: request_master_id, part, user_id, address_id, delivery_date, requests.
    """
    pending = request_status.filter(F.col("status_name") == "Pending").select("request_status_id").scalar()
    state = [
        F.lit("Pending").alias("status"), "request_status_id", F.lit(False).alias("delete_status"),
        moment(now).alias("created_at"), moment(now).alias("updated_at"),
    ]
    coded = _parsed(batch, "request_master_id", "requests", REQUEST_ITEMS_JSON)[0].withColumn("request_status_id", pending)
    masters = coded.filter(F.col("part") == 0).select("request_master_id", "user_id", "address_id", "delivery_date", *state)
    parsed = _exploded(coded, "*")
    requests = parsed.select("request_master_id", "part", "pos", "item.*", *state)
    return masters, requests


def unread_requests(batch: DataFrame) -> DataFrame:
    """(request_master_id, part, requests, reason): documents of a request batch that are no JSON array."""
    return _parsed(batch, "request_master_id", "requests", REQUEST_ITEMS_JSON)[1]


def number_items(items, start=0, name="order_item_id", key="order_id") -> DataFrame:
    """Give new items their ids: by order, and within one from the last item to the first."""
    return dense_ids(items, name, [F.asc(key), F.desc("part"), F.desc("pos")], start)


def create_orders(batch, requests, masters, approvals, now, array_rows=ARRAY_ROWS) -> dict[str, DataFrame]:
    """A batch of orders from intake to audit: new rows of every table touched, and what was blocked.

    The parsed items feed five results, so they are written out once.
    """
    new = ingest_orders(batch, now)
    passed, blocked = gate_items(cut(new["items"]), requests, approvals, array_rows)
    done_requests, done_masters = complete_requests(requests, masters, passed, now)
    return {
        "orders": schedule_from_request(new["orders"], passed, requests, masters),
        "items": passed,
        "history": new["history"],
        "rejects": new["rejects"],
        "blocked": blocked,
        "requests": done_requests,
        "masters": done_masters,
        "datalog": order_audit(new["orders"], passed, requests, now, array_rows),
    }
