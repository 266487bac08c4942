"""Registered report queries (``QUERIES``) and the SQL that checks them (``ORACLE``)."""

from datetime import date, datetime

from storelytics.operators import reports as R
from storelytics.sources.bound import oracle_ctes

YEAR = (date(1996, 1, 1), date(1996, 12, 31))
# Event times fall inside the day, so this window shows that the end day ends at its first instant.
EVENTS = (date(2024, 1, 5), date(2024, 1, 20))

QUERIES = {
    "r01_order_summary": lambda t: R.order_summary(t.orders, *YEAR),
    "r01_order_summary_status": lambda t: R.order_summary(t.orders, *YEAR, status="Shipped"),
    "r02_order_daily_by_status": lambda t: R.order_daily_by_status(t.orders, *YEAR),
    "r03_revenue_summary": lambda t: R.revenue_summary(t.orders, *YEAR),
    "r04_revenue_daily": lambda t: R.revenue_by(t.orders, *YEAR, "daily"),
    "r05_revenue_weekly": lambda t: R.revenue_by(t.orders, *YEAR, "weekly"),
    "r06_revenue_monthly": lambda t: R.revenue_by(t.orders, *YEAR, "monthly"),
    "r07_best_selling": lambda t: R.best_selling(t.products, t.order_items, t.orders, *YEAR),
    "r08_low_stock": lambda t: R.low_stock(t.products),
    "r09_category_performance": lambda t: R.category_performance(t.products, t.order_items, t.orders, *YEAR),
    "r10_top_customers": lambda t: R.top_customers(t.users, t.orders, *YEAR),
    "r11_new_customers": lambda t: R.new_customers_daily(t.signups, *EVENTS),
    "r11_new_customers_whole_day": lambda t: R.new_customers_daily(t.signups, *EVENTS, whole_end_day=True),
    "r12_customer_retention": lambda t: R.customer_retention(t.users, t.orders, *YEAR),
    "r13_order_total": lambda t: R.order_total(
        t.orders, t.order_status, "Shipped", datetime(1996, 1, 1), datetime(1996, 12, 31)
    ),
}

# The order status code table, as SQL.
STATUS_CTE = """t_order_status AS (SELECT * FROM (VALUES (1, 'Pending'), (2, 'Processed'), (3, 'Shipped'),
    (4, 'Delivered'), (5, 'Canceled'), (6, 'Returned'), (7, 'Failed'), (8, 'Refunded')) s(order_status_id, status_name))"""

IN_YEAR = "created_at BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"


def with_tables(names: str, body: str) -> str:
    """``body`` over the logical tables ``t_<name>``."""
    tables = names.split()
    ctes = [oracle_ctes(*[n for n in tables if n != "order_status"])] if tables != ["order_status"] else []
    if "order_status" in tables:
        ctes.append(STATUS_CTE)
    return f"WITH {', '.join(ctes)}\n{body}"


def _revenue(key: str, name: str) -> str:
    return with_tables(
        "orders",
        f"""SELECT {key} AS {name}, count(*) AS orders, CAST(sum(total) AS DECIMAL(28,2)) AS revenue
        FROM t_orders WHERE {IN_YEAR} GROUP BY 1""",
    )


def _summary(extra: str = "") -> str:
    return with_tables(
        "orders",
        f"""SELECT count(*) AS total_orders, CAST(sum(total) AS DECIMAL(28,2)) AS total_revenue,
        CAST(avg(total) AS DECIMAL(20,6)) AS average_order_value, count(DISTINCT user_id) AS unique_customers
        FROM t_orders WHERE {IN_YEAR} {extra}""",
    )


SUNDAY = "(CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INTEGER))"

ORACLE = {
    "r01_order_summary": _summary(),
    "r01_order_summary_status": _summary("AND status = 'Shipped'"),
    "r02_order_daily_by_status": with_tables(
        "orders",
        f"""SELECT CAST(created_at AS DATE) AS date, status, count(*) AS order_count,
        CAST(sum(total) AS DECIMAL(28,2)) AS daily_revenue FROM t_orders WHERE {IN_YEAR} GROUP BY 1, 2""",
    ),
    "r03_revenue_summary": with_tables(
        "orders",
        f"""SELECT CAST(sum(total) AS DECIMAL(28,2)) AS total_revenue, count(*) AS total_orders,
        CAST(sum(total) / count(*) AS DECIMAL(20,6)) AS average_order_value FROM t_orders WHERE {IN_YEAR}""",
    ),
    "r04_revenue_daily": _revenue("CAST(created_at AS DATE)", "date"),
    "r05_revenue_weekly": _revenue(
        f"CAST(year({SUNDAY}) * 100 + (dayofyear({SUNDAY}) - 1) // 7 + 1 AS INTEGER)", "week"
    ),
    "r06_revenue_monthly": _revenue("strftime(created_at, '%Y-%m')", "month"),
    "r07_best_selling": with_tables(
        "products order_items orders",
        f"""SELECT p.product_id, p.name, CAST(sum(i.quantity) AS BIGINT) AS total_quantity,
        CAST(sum(i.quantity * i.price) AS DECIMAL(28,2)) AS total_revenue
        FROM t_products p JOIN t_order_items i ON p.product_id = i.product_id
        JOIN t_orders o ON i.order_id = o.order_id WHERE o.{IN_YEAR}
        GROUP BY p.product_id, p.name ORDER BY total_quantity DESC, p.product_id LIMIT 10""",
    ),
    "r08_low_stock": with_tables("products", "SELECT * FROM t_products WHERE stock <= 10"),
    "r09_category_performance": with_tables(
        "products order_items orders",
        f"""SELECT p.category AS category_name, count(DISTINCT o.order_id) AS total_orders,
        CAST(sum(i.quantity) AS BIGINT) AS total_items_sold,
        CAST(sum(i.quantity * i.price) AS DECIMAL(28,2)) AS total_revenue
        FROM t_products p JOIN t_order_items i ON p.product_id = i.product_id
        JOIN t_orders o ON i.order_id = o.order_id WHERE o.{IN_YEAR} GROUP BY p.category""",
    ),
    "r10_top_customers": with_tables(
        "users orders",
        f"""SELECT u.user_id, u.name, u.email, count(DISTINCT o.order_id) AS total_orders,
        CAST(sum(o.total) AS DECIMAL(28,2)) AS total_spent
        FROM t_users u JOIN t_orders o ON u.user_id = o.user_id WHERE o.{IN_YEAR}
        GROUP BY 1, 2, 3 ORDER BY total_spent DESC, u.user_id LIMIT 10""",
    ),
    "r11_new_customers": with_tables(
        "signups",
        """SELECT CAST(created_at AS DATE) AS date, count(*) AS new_customers FROM t_signups
        WHERE created_at BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND role = 'customer' GROUP BY 1""",
    ),
    "r11_new_customers_whole_day": with_tables(
        "signups",
        """SELECT CAST(created_at AS DATE) AS date, count(*) AS new_customers FROM t_signups
        WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND role = 'customer'
        GROUP BY 1""",
    ),
    "r12_customer_retention": with_tables(
        "users orders",
        f"""SELECT count(DISTINCT CASE WHEN n > 1 THEN u.user_id END) AS returning_customers,
        count(DISTINCT u.user_id) AS total_customers,
        CAST(count(DISTINCT CASE WHEN n > 1 THEN u.user_id END) * 100 / count(DISTINCT u.user_id)
             AS DECIMAL(20,4)) AS retention_rate
        FROM t_users u JOIN (SELECT user_id, count(*) AS n FROM t_orders WHERE {IN_YEAR} GROUP BY user_id) c
        ON u.user_id = c.user_id""",
    ),
    "r13_order_total": with_tables(
        "orders order_status",
        f"""SELECT CAST(sum(o.total) AS DECIMAL(28,2)) AS total_amount FROM t_orders o
        LEFT JOIN t_order_status s ON o.order_status_id = s.order_status_id
        WHERE s.status_name = 'Shipped' AND o.{IN_YEAR} AND NOT o.delete_status""",
    ),
}
