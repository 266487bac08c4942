"""Customer and product listings, lookups and public projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.claims import blind, matched
from storelytics.functions.predicates import equals, having_ids, page, search
from storelytics.operators.orders import recent_orders
from storelytics.schemas import MONEY_SUM

SEARCHED = ["name", "email", "phone"]
PUBLIC = ["user_id", "name", "email", "phone", "role", "size_preferences"]
SECRET = ["password"]


def _customers(users, text, ignore_accents) -> DataFrame:
    return search(users.filter(F.col("role") == "customer"), SEARCHED, text, ignore_accents)


def customer_count(users, text=None, ignore_accents=False) -> DataFrame:
    """Customers whose name, email or phone contains the text."""
    return _customers(users, text, ignore_accents).agg(F.count("user_id").alias("total"))


def _spend(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(
        F.count("*").alias("total_orders"), F.sum("total").cast(MONEY_SUM).alias("total_spent")
    )


def _with_spend(users, orders) -> DataFrame:
    joined = users.drop(*SECRET).join(_spend(orders), "user_id", "left")
    return joined.withColumn("total_orders", F.coalesce("total_orders", F.lit(0)))


def customers_ranked(users, orders, text=None, limit=10, offset=0, ignore_accents=False) -> DataFrame:
    """One page of customers by spend; those without orders count as having spent 0."""
    spent = _with_spend(_customers(users, text, ignore_accents), orders)
    spent = spent.withColumn("total_spent", F.coalesce("total_spent", F.lit(0).cast(MONEY_SUM)))
    return page(spent, [F.desc("total_spent"), F.asc("user_id")], limit, offset)


def customer_stats(users, orders, ids=None) -> DataFrame:
    """Users with their order totals; ``total_spent`` stays NULL without orders."""
    return _with_spend(having_ids(users, "user_id", ids), having_ids(orders, "user_id", ids))


def addresses_of(addresses, ids=None, active_only=True) -> DataFrame:
    rows = having_ids(addresses, "user_id", ids)
    return rows.filter(~F.col("delete_status")) if active_only else rows


def lookup_users(users, probes) -> DataFrame:
    """Resolve probes (probe_id, value, login_type) by email or by phone: one equi-join per kind."""
    found = [
        matched(
            probes.filter(F.col("login_type") == kind).withColumn("_value", blind("value")),
            users.select("user_id", "email", "phone", "role").withColumn("_value", blind(kind)), "_value", "inner",
        )
        for kind in ("email", "phone")
    ]
    return found[0].unionByName(found[1]).select("probe_id", "user_id", "email", "phone", "role")


def lookup_social(users, social_users, probes) -> DataFrame:
    """Resolve probes (probe_id, social_id, social_type) to users."""
    links = social_users.select("social_id", "social_type", "user_id")
    return (
        probes.select("probe_id", "social_id", "social_type")
        .join(links, ["social_id", "social_type"])
        .join(users.select(*PUBLIC), "user_id")
        .select("probe_id", *PUBLIC)
    )


def user_public(users, ids=None) -> DataFrame:
    return having_ids(users, "user_id", ids).select(*PUBLIC)


def user_profile(users, ids=None) -> DataFrame:
    """All columns of a user except credentials."""
    return having_ids(users, "user_id", ids).drop(*SECRET)


def _listed(products, category, text) -> DataFrame:
    return search(equals(products.filter(~F.col("delete_status")), "category", category), ["name", "description"], text)


def product_listing(products, category=None, text=None, limit=10, offset=0) -> DataFrame:
    return page(_listed(products, category, text), ["product_id"], limit, offset)


def product_count(products, category=None, text=None) -> DataFrame:
    return _listed(products, category, text).agg(F.count("*").alias("total"))


def customer_details(users, orders, items, addresses, ids=None, n=10) -> dict[str, DataFrame]:
    """Profile totals, the ``n`` latest orders and all addresses of the given customers."""
    return {
        "customers": customer_stats(users, orders, ids),
        "orders": recent_orders(orders, items, ids, n),
        "addresses": addresses_of(addresses, ids, active_only=False),
    }
