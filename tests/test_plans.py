"""The plans the jobs are meant to have."""

import pytest
from oracle import DATA

from storelytics.plans import catalog

QUERIES = catalog.queries()
PAGE_SCANS = {"p03", "p04", "p05", "p06", "p09", "p10", "p11", "p12", "p13", "p15", "p16"}


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r07_best_selling", "r10_top_customers", "l11_customers_ranked", "l18_product_listing"])
def test_pages_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("s0")))
def test_no_cross_product_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert ("MapInArrow" in text) == (name[:3] in PAGE_SCANS)
    assert "Python" not in text.replace("PythonMapInArrow", "") and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["p03_element_counts", "p06_title", "p10_image", "p15_link_preview", "p16_site_preview"])
def test_html_is_under_no_exchange(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_date_windows_reach_the_scan(spark):
    text = plan(spark, "r03_revenue_summary")
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_recent_orders_are_cut_before_the_shuffle(spark):
    assert plan(spark, "l13_recent_orders").count("WindowGroupLimit") == 2


def test_codes_are_broadcast_without_a_shuffle_of_orders(spark):
    text = plan(spark, "l03_order_header")
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_gathered_arrays_are_never_broadcast(spark):
    assert "SortMergeJoin" in plan(spark, "l02_user_orders")


def test_executors_need_no_package(spark):
    """The page scan must reach Python workers that cannot import this package."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from storelytics.operators.preview import scan

    blob = cloudpickle.dumps(scan._listed)
    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); print(len(f('<title>x</title><h1>y</h1>')[1]))"
    done = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd="/", env={"PATH": "/usr/bin"})
    assert done.stdout.strip() == b"2", done.stderr
    whole, (only,) = pickle.loads(blob)("<h1>a</h1>")
    assert whole[only["start"]:only["until"]] == b"a"
