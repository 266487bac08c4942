"""Logical tables, JSON shapes and code tables.

Timestamps are ``timestamp_ntz`` holding UTC wall time, so results do not depend on the session zone.
Flags are booleans; a NULL flag is neither set nor unset, so ``~flag`` drops it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(28,2)"
MONEY_AVG = "decimal(20,6)"
PERCENT = "decimal(20,4)"

TABLES = {
    "users": "user_id long, name string, last_name string, email string, phone string, role string, "
    "created_at timestamp_ntz, social_id string, social_type string, updated_at timestamp_ntz, "
    "size_preferences string, delete_status boolean",
    "social_users": "id long, user_id long, social_id string, social_type string, created_at timestamp_ntz",
    "addresses": "address_id long, user_id long, address_line string, city string, state string, "
    "zip_code string, country string, created_at timestamp_ntz, delete_status boolean",
    "products": f"product_id long, name string, description string, image string, price {MONEY}, stock int, "
    "category string, created_at timestamp_ntz, delete_status boolean",
    "orders": f"order_id long, user_id long, address_id long, status string, order_status_id int, "
    f"scheduled_time string, subtotal {MONEY}, service_charge {MONEY}, delivery_charge {MONEY}, total {MONEY}, "
    "created_at timestamp_ntz, delete_status boolean, updated_at timestamp_ntz",
    "order_items": "order_item_id long, order_id long, is_custom_product boolean, product_id long, "
    f"product_request_id long, approval_id long, quantity int, price {MONEY}, delete_status boolean",
    "order_history": "history_id long, order_id long, status string, order_status_id int, "
    "updated_at timestamp_ntz, updated_by long",
    "datalog": "log_id long, order_id long, affected_request_masters string, approved_requests string, "
    "created_at timestamp_ntz",
    "request_masters": "request_master_id long, user_id long, request_status_id int, address_id long, "
    "status string, delete_status boolean, created_at timestamp_ntz, updated_at timestamp_ntz, delivery_date string",
    "requests": "request_id long, request_master_id long, product_name string, description string, "
    "requested_size string, requested_color string, request_status_id int, status string, image string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, delete_status boolean",
    "approvals": f"approval_id long, request_id long, approved_by long, approved_size string, "
    f"approved_color string, approved_price {MONEY}, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "delete_status boolean",
}

# JSON document shapes.
# Fields come as JSON numbers or as quoted ones, so they are read as text and converted then.
ORDER_ITEMS_JSON = (
    "array<struct<is_custom_product:string,product_id:string,product_request_id:string,"
    "quantity:string,price:string,approval_id:string>>"
)
REQUEST_ITEMS_JSON = (
    "array<struct<product_name:string,description:string,requested_size:string,requested_color:string,image:string>>"
)
APPROVAL_OPTIONS_JSON = "array<struct<size:string,color:string,price:decimal(12,2)>>"

# Status code tables.
ORDER_STATUS = {
    1: "Pending",
    2: "Processed",
    3: "Shipped",
    4: "Delivered",
    5: "Canceled",
    6: "Returned",
    7: "Failed",
    8: "Refunded",
}
REQUEST_STATUS = {1: "Pending", 2: "Approved", 3: "Rejected", 4: "Completed"}


def _codes(spark: SparkSession, codes: dict[int, str], key: str) -> DataFrame:
    # From Arrow this is a local relation of known size; from a Python list it would be an RDD of unknown size.
    table = pa.table({key: pa.array(codes.keys(), pa.int32()), "status_name": list(codes.values())})
    return spark.createDataFrame(table)


def order_status(spark: SparkSession) -> DataFrame:
    return _codes(spark, ORDER_STATUS, "order_status_id")


def request_status(spark: SparkSession) -> DataFrame:
    return _codes(spark, REQUEST_STATUS, "request_status_id")
