from datetime import date

import pytest

from storelytics import session
from storelytics.operators import customers as C
from storelytics.operators import reports as R
from storelytics.sources.tables import current, publish


def test_versions(frame, tmp_path):
    old = frame("id long,user_id long,social_id string,social_type string,created_at timestamp_ntz", (1, 1, "a", "g", "2024-01-01"))
    publish(old, str(tmp_path), "social_users", 1)
    spark = old.sparkSession
    grown = current(spark, str(tmp_path), "social_users").unionByName(old.withColumn("id", old["id"] + 1))
    publish(grown, str(tmp_path), "social_users", 2, ["social_type"])
    rows = current(spark, str(tmp_path), "social_users")
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    assert rows.columns == old.columns


def test_reports_come_as_named_results(tables):
    year = (date(1996, 1, 1), date(1996, 12, 31))
    assert set(R.order_report(tables.orders, *year)) == {"summary", "orders"}
    assert set(R.revenue_report(tables.orders, *year, "weekly")) == {"summary", "revenue_data"}
    assert set(R.product_report(tables.products, tables.order_items, tables.orders, *year)) == {
        "best_selling", "low_stock", "category_performance"}
    report = R.customer_report(tables.users, tables.orders, *year)
    assert report["top_customers"].count() == 10
    details = C.customer_details(tables.users, tables.orders, tables.order_items, tables.addresses, ids=[5, 7], n=2)
    assert details["customers"].count() == 2 and details["orders"].count() == 4 and details["addresses"].count() == 2


def test_only_a_local_session_may_use_a_local_folder():
    from types import SimpleNamespace

    def made(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default=None: default))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(made(master))
    assert session.shared_folder(made("local[4]")) and session.shared_folder(made("local"))
