"""JSON intake batches built from the bound tables, in documents of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.nest import ARRAY_ROWS, as_json, attach, gather

ITEM = ["is_custom_product", "product_id", "product_request_id", "quantity", "price", "approval_id"]
LINE = ["line", "product_id", "product_request_id", "price", "quantity", "approval_id", "is_custom_product"]
REQUEST = ["product_name", "description", "requested_size", "requested_color", "image"]


def order_batch(orders: DataFrame, new_items: DataFrame, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """One JSON document of items per order."""
    arrays = gather(new_items, "order_id", LINE, F.struct(*ITEM), "items", array_rows)
    headers = orders.select("order_id", "user_id", "address_id", "subtotal", "service_charge", "delivery_charge", "total")
    return attach(headers, arrays, "order_id", "items").withColumn("items", as_json("items"))


def request_batch(masters: DataFrame, requests: DataFrame, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """One JSON document of requests per master."""
    arrays = gather(requests, "request_master_id", ["request_id"], F.struct(*REQUEST), "requests", array_rows)
    headers = masters.select("request_master_id", "user_id", "address_id", "delivery_date")
    return attach(headers, arrays, "request_master_id", "requests").withColumn("requests", as_json("requests"))
