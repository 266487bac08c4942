"""Applying batches of changes to tables: ``new state = f(current, changes)``.

There is no table format underneath: the result is a DataFrame to be written to a new location. Several
changes of one key are reduced by an aggregate before anything is joined, so the join is one row to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.ids import dense_ids, highest
from storelytics.functions.latest import last_per_key

_HIT = "_hit"


def overlay(current: DataFrame, patch: DataFrame, keys: list[str], new: dict[str, Column], only: Column | None = None):
    """``current`` with the columns in ``new`` replaced where ``patch`` has the key (and ``only`` holds).

    ``patch`` has one row per key; its columns are read as ``patch.<name>`` inside ``new``.
    """
    body = patch.select(*keys, F.struct(*[c for c in patch.columns]).alias("patch"), F.lit(True).alias(_HIT))
    hit = F.coalesce(F.col(_HIT), F.lit(False))
    if only is not None:
        hit = hit & F.coalesce(only, F.lit(False))
    joined = current.join(body, keys, "left")
    columns = []
    for name in current.columns:
        if name in new:
            kind = current.schema[name].dataType
            columns.append(F.when(hit, new[name].cast(kind)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def patch(current: DataFrame, changes: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Set columns by key to the last change, NULL included; unknown keys change nothing."""
    last = last_per_key(changes.select(key, *order, *columns), [key], order)
    return overlay(current, last, [key], {c: F.col(f"patch.{c}") for c in columns})


def upsert(current, changes, keys, set_columns, order, reset: dict[str, Column] | None = None) -> DataFrame:
    """Insert new keys; for known ones set ``set_columns`` to the last change and ``reset`` to its constants."""
    reset = reset or {}
    last = last_per_key(changes.select(*keys, *order, *set_columns), keys, order)
    known = current.select("*", F.lit(True).alias("_known"))
    both = known.join(last.select(*keys, F.struct(*set_columns).alias("patch"), F.lit(True).alias(_HIT)), keys, "full_outer")
    columns = []
    for name in current.columns:
        kind = current.schema[name].dataType
        if name in keys:
            columns.append(F.col(name))
        elif name in set_columns:
            columns.append(F.when(F.col(_HIT), F.col(f"patch.{name}").cast(kind)).otherwise(F.col(name)).alias(name))
        elif name in reset:
            columns.append(F.when(F.col(_HIT), reset[name].cast(kind)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return both.select(*columns)


def apply_addresses(addresses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert, update and soft-delete addresses; update and delete need the owner's id to match.

    ``changes``: change_id, kind, address_id, user_id and the address columns. Returns the addresses and,
    per kind, how many changes came in and how many found their row.
    """
    columns = ["address_line", "city", "state", "zip_code", "country"]
    keys = ["address_id", "user_id"]
    updates = last_per_key(changes.filter(F.col("kind") == "update").select(*keys, "change_id", *columns), keys, ["change_id"])
    deleted = changes.filter(F.col("kind") == "delete").select(*keys).distinct()
    updated = overlay(addresses, updates, keys, {c: F.col(f"patch.{c}") for c in columns})
    kept = overlay(updated, deleted, keys, {"delete_status": F.lit(True)})
    inserts = changes.filter(F.col("kind") == "insert").select("change_id", "user_id", *columns)
    numbered = dense_ids(inserts, "address_id", ["change_id"], highest(addresses, "address_id"))
    fresh = numbered.drop("change_id").withColumn("delete_status", F.lit(False))
    targets = changes.filter(F.col("kind") != "insert").groupBy("kind", *keys).agg(F.count("*").alias("n"))
    owners = addresses.select(*keys, F.lit(True).alias("_known"))
    counts = (
        targets.join(owners, keys, "left")
        .groupBy("kind")
        .agg(F.sum("n").alias("changes"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("n"))), F.lit(0)).alias("matched"))
    )
    return kept.unionByName(fresh, allowMissingColumns=True), counts


def reschedule(orders: DataFrame, changes: DataFrame, owner_checked: bool = True) -> DataFrame:
    """Set the delivery time of orders; by default only where the change names the order's own user.

    ``changes``: change_id, order_id, user_id, delivery_time, at.
    """
    keys = ["order_id", "user_id"] if owner_checked else ["order_id"]
    last = last_per_key(changes.select(*keys, "change_id", "delivery_time", "at"), keys, ["change_id"])
    new = {"scheduled_time": F.col("patch.delivery_time"), "updated_at": F.col("patch.at")}
    return overlay(orders, last, keys, new)


def apply_products(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Add, update and soft-delete catalogue products.

    ``changes``: change_id, kind, product_id (NULL for add), name, description, price, stock, category.
    """
    columns = ["name", "description", "price", "stock", "category"]
    updates = changes.filter(F.col("kind") == "update")
    changed = patch(products, updates, "product_id", columns, ["change_id"])
    gone = changes.filter(F.col("kind") == "delete").select("product_id").distinct()
    kept = overlay(changed, gone, ["product_id"], {"delete_status": F.lit(True)})
    added = changes.filter(F.col("kind") == "add").select("change_id", *columns)
    numbered = dense_ids(added, "product_id", ["change_id"], highest(products, "product_id"))
    fresh = numbered.drop("change_id").withColumn("delete_status", F.lit(False))
    return kept.unionByName(fresh, allowMissingColumns=True)
