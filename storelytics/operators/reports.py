"""Sales, product and customer reports.

Reports look at ``orders.status`` and count deleted and canceled orders too; listings do neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.calendar import month_key, year_week
from storelytics.functions.predicates import equals, page, within
from storelytics.schemas import MONEY_AVG, MONEY_SUM, PERCENT


def _money(column) -> F.Column:
    return F.sum(column).cast(MONEY_SUM)


def order_summary(orders: DataFrame, start, end, status=None, whole_end_day=False) -> DataFrame:
    """Order count, revenue, mean order value and number of distinct customers."""
    rows = equals(within(orders, "created_at", start, end, whole_end_day), "status", status)
    # One row per customer first: a distinct count in the same pass would copy every order.
    per_user = rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("total").alias("paid"), F.count("total").alias("priced")
    )
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"),
        _money("paid").alias("total_revenue"),
        F.try_divide(F.sum("paid"), F.sum("priced")).cast(MONEY_AVG).alias("average_order_value"),
        F.count("user_id").alias("unique_customers"),
    )


def order_daily_by_status(orders: DataFrame, start, end, status=None, whole_end_day=False) -> DataFrame:
    """Orders and revenue per day and status, newest day first."""
    rows = equals(within(orders, "created_at", start, end, whole_end_day), "status", status)
    return (
        rows.groupBy(F.to_date("created_at").alias("date"), "status")
        .agg(F.count("*").alias("order_count"), _money("total").alias("daily_revenue"))
        .orderBy(F.desc("date"), "status")
    )


def revenue_summary(orders: DataFrame, start, end, whole_end_day=False) -> DataFrame:
    rows = within(orders, "created_at", start, end, whole_end_day)
    return rows.agg(
        _money("total").alias("total_revenue"),
        F.count("*").alias("total_orders"),
        F.try_divide(F.sum("total"), F.count("*")).cast(MONEY_AVG).alias("average_order_value"),
    )


PERIODS = {
    "daily": ("date", F.to_date),
    "weekly": ("week", year_week),
    "monthly": ("month", month_key),
}


def revenue_by(orders: DataFrame, start, end, period="daily", whole_end_day=False) -> DataFrame:
    """Orders and revenue per day, week or month."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}; got {period!r}")
    name, key = PERIODS[period]
    return (
        within(orders, "created_at", start, end, whole_end_day)
        .groupBy(key(F.col("created_at")).alias(name))
        .agg(F.count("*").alias("orders"), _money("total").alias("revenue"))
        .orderBy(name)
    )


def _sold(items: DataFrame, orders: DataFrame, start, end, whole_end_day) -> DataFrame:
    """Item lines of the orders in the window, reduced to what the product reports read."""
    inside = within(orders, "created_at", start, end, whole_end_day).select("order_id")
    lines = items.select("order_id", "product_id", "quantity", (F.col("quantity") * F.col("price")).alias("amount"))
    return lines.filter(F.col("product_id").isNotNull()).join(inside, "order_id", "left_semi")


def best_selling(products, items, orders, start, end, n=10, whole_end_day=False) -> DataFrame:
    """The ``n`` products with the most units sold. Lines shrink to one row per product before names join."""
    sold = (
        _sold(items, orders, start, end, whole_end_day)
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("total_quantity"), _money("amount").alias("total_revenue"))
    )
    named = products.select("product_id", "name").join(sold, "product_id")
    return page(named, [F.desc("total_quantity"), F.asc("product_id")], n)


def low_stock(products: DataFrame, threshold=10) -> DataFrame:
    return products.filter(F.col("stock") <= threshold).orderBy("stock", "product_id")


def category_performance(products, items, orders, start, end, whole_end_day=False) -> DataFrame:
    """Distinct orders, units and revenue per category.

    Counting goes in two steps, per (category, order) and then per category, so a category that
    sells a third of everything is still summed by many tasks.
    """
    sold = _sold(items, orders, start, end, whole_end_day)
    per_order = (
        sold.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "order_id")
        .agg(F.sum("quantity").alias("units"), F.sum("amount").alias("amount"))
    )
    return (
        per_order.groupBy(F.col("category").alias("category_name"))
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("units").alias("total_items_sold"),
            _money("amount").alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "category_name")
    )


def top_customers(users, orders, start, end, n=10, whole_end_day=False) -> DataFrame:
    """The ``n`` users of any role who spent the most."""
    spent = (
        within(orders, "created_at", start, end, whole_end_day)
        .groupBy("user_id")
        .agg(F.count("*").alias("total_orders"), _money("total").alias("total_spent"))
    )
    named = users.select("user_id", "name", "email").join(spent, "user_id")
    return page(named, [F.desc("total_spent"), F.asc("user_id")], n)


def new_customers_daily(users, start, end, whole_end_day=False) -> DataFrame:
    return (
        within(users, "created_at", start, end, whole_end_day)
        .filter(F.col("role") == "customer")
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("new_customers"))
        .orderBy("date")
    )


def customer_retention(users, orders, start, end, whole_end_day=False) -> DataFrame:
    """Customers with more than one order in the window, all customers with one, and the rate in percent."""
    per_user = (
        within(orders, "created_at", start, end, whole_end_day).groupBy("user_id").agg(F.count("*").alias("n"))
    )
    known = per_user.join(users.select("user_id"), "user_id", "left_semi")
    returning = F.count_if(F.col("n") > 1)
    return known.agg(
        returning.alias("returning_customers"),
        F.count("*").alias("total_customers"),
        F.try_divide(returning * 100, F.count("*")).cast(PERCENT).alias("retention_rate"),
    )


def order_total(orders, order_status, status=None, start=None, end=None) -> DataFrame:
    """Sum over the undeleted orders that the order listing shows, filtered like it on the status name."""
    rows = within(orders, "created_at", start, end).filter(~F.col("delete_status"))
    named = rows.join(order_status, "order_status_id", "left")
    return equals(named, "status_name", status).agg(_money("total").alias("total_amount"))


def order_report(orders, start, end, status=None, whole_end_day=False) -> dict[str, DataFrame]:
    args = (orders, start, end, status, whole_end_day)
    return {"summary": order_summary(*args), "orders": order_daily_by_status(*args)}


def revenue_report(orders, start, end, period="daily", whole_end_day=False) -> dict[str, DataFrame]:
    return {
        "summary": revenue_summary(orders, start, end, whole_end_day),
        "revenue_data": revenue_by(orders, start, end, period, whole_end_day),
    }


def product_report(products, items, orders, start, end, whole_end_day=False) -> dict[str, DataFrame]:
    window = (start, end)
    return {
        "best_selling": best_selling(products, items, orders, *window, whole_end_day=whole_end_day),
        "low_stock": low_stock(products),
        "category_performance": category_performance(products, items, orders, *window, whole_end_day),
    }


def customer_report(users, orders, start, end, whole_end_day=False) -> dict[str, DataFrame]:
    window = (start, end)
    return {
        "top_customers": top_customers(users, orders, *window, whole_end_day=whole_end_day),
        "new_customers": new_customers_daily(users, *window, whole_end_day),
        "customer_retention": customer_retention(users, orders, *window, whole_end_day),
    }
