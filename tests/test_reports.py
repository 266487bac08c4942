from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelytics.functions.calendar import year_week
from storelytics.operators import reports as R

ORDERS = "order_id long,user_id long,status string,order_status_id int,total decimal(12,2),created_at timestamp_ntz,delete_status boolean"


@pytest.fixture
def orders(frame):
    return frame(
        ORDERS,
        (1, 1, "Pending", 3, "10.00", "2024-01-01 00:00:00", False),
        (2, 1, "Canceled", 5, "20.00", "2024-01-02 09:00:00", True),
        (3, 2, "Shipped", 3, "30.00", "2024-01-03 00:00:00", False),
        (4, 3, "Shipped", 3, "40.00", "2024-01-03 10:00:00", False),
        (5, 4, "Shipped", 3, None, "2024-01-02 10:00:00", None),
    )


WINDOW = (date(2024, 1, 1), date(2024, 1, 3))


def test_end_day_counts_only_at_midnight(orders):
    assert R.revenue_summary(orders, *WINDOW).first().total_orders == 4
    assert R.revenue_summary(orders, *WINDOW, whole_end_day=True).first().total_orders == 5
    late = datetime(WINDOW[1].year, WINDOW[1].month, WINDOW[1].day, 15)
    assert R.revenue_summary(orders, WINDOW[0], late, whole_end_day=True).first().total_orders == 5


def test_datetime_bounds(orders):
    end = datetime(2024, 1, 3, 10, 0)
    assert R.revenue_summary(orders, WINDOW[0], end).first().total_orders == 5


def test_reports_count_deleted_orders_and_listing_total_does_not(orders, spark):
    from storelytics.schemas import order_status

    assert R.revenue_summary(orders, *WINDOW).first().total_revenue == Decimal("60.00")
    # by the name of the status id, not by the status text; NULL flags are neither deleted nor kept
    assert R.order_total(orders, order_status(spark), "Shipped").first().total_amount == Decimal("80.00")


def test_report_filters_on_status_text(orders):
    assert R.order_summary(orders, *WINDOW, status="Shipped").first().total_orders == 2
    assert R.order_summary(orders, *WINDOW, status="Pending").first().total_orders == 1


def test_missing_totals_count_as_orders_but_not_in_the_mean(orders):
    row = R.order_summary(orders, *WINDOW).first()
    assert (row.total_orders, row.unique_customers, row.average_order_value) == (4, 3, Decimal("20.000000"))
    assert R.revenue_summary(orders, *WINDOW).first().average_order_value == Decimal("15.000000")


def test_empty_window(orders, frame):
    none = (date(2030, 1, 1), date(2030, 2, 1))
    row = R.order_summary(orders, *none).first()
    assert (row.total_orders, row.total_revenue, row.average_order_value, row.unique_customers) == (0, None, None, 0)
    assert R.revenue_summary(orders, *none).first().average_order_value is None
    users = frame("user_id long,name string", (1, "a"))
    row = R.customer_retention(users, orders, *none).first()
    assert (row.returning_customers, row.total_customers, row.retention_rate) == (0, 0, None)


def test_unknown_period(orders):
    with pytest.raises(ValueError):
        R.revenue_by(orders, *WINDOW, "hourly")


def test_periods_sum_to_the_summary(tables):
    year = (date(1996, 1, 1), date(1996, 12, 31))
    total = R.revenue_summary(tables.orders, *year).first()
    for period in R.PERIODS:
        row = R.revenue_by(tables.orders, *year, period).agg(F.sum("orders").alias("n"), F.sum("revenue").alias("r")).first()
        assert (row.n, row.r) == (total.total_orders, total.total_revenue)


def test_week_keys(frame):
    days = {
        "1987-01-01": 198652, "2022-01-01": 202152, "2023-01-01": 202301, "2024-12-31": 202452,
        "2025-01-01": 202452, "2025-01-04": 202452, "2025-01-05": 202501,
    }
    rows = frame("d string", *[(d,) for d in days]).select("d", year_week(F.to_timestamp_ntz("d", F.lit("yyyy-MM-dd"))).alias("w"))
    assert {r.d: r.w for r in rows.collect()} == days


def test_ties_are_cut_by_key(frame):
    users = frame("user_id long,name string,email string", *[(i, "n", None) for i in range(1, 6)])
    orders = frame("user_id long,total decimal(12,2),created_at timestamp_ntz", *[(i, "5.00", "2024-01-01") for i in (5, 4, 3, 2, 1)])
    top = R.top_customers(users, orders, *WINDOW, n=3).collect()
    assert [r.user_id for r in top] == [1, 2, 3]


def test_top_customers_take_any_role_and_new_customers_one(frame):
    users = frame(
        "user_id long,name string,email string,role string,created_at timestamp_ntz",
        (1, "a", None, "admin", "2024-01-01"), (2, "b", None, "customer", "2024-01-01"),
    )
    orders = frame("user_id long,total decimal(12,2),created_at timestamp_ntz", (1, "5.00", "2024-01-01"))
    assert R.top_customers(users, orders, *WINDOW).first().user_id == 1
    assert R.new_customers_daily(users, *WINDOW).first().new_customers == 1
