"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the driver tables (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS the timed runs per
query; the median counts. Each query is planned anew in every run. Reports are fetched, as their readers do;
all other results are written to a sink that drops them. Untimed runs of every query come first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from storelytics import session
from storelytics.plans import catalog

HEADLINE = [
    "r01_order_summary", "r03_revenue_summary", "r04_revenue_daily", "r07_best_selling", "r09_category_performance",
    "r10_top_customers", "r11_new_customers", "r12_customer_retention", "l01_order_listing", "l02_user_orders",
    "l04_order_item_details", "l07_request_detail", "l11_customers_ranked", "l13_recent_orders", "m01_ingest_items",
    "m02_blocked_products", "m07_apply_decisions", "m09_update_status", "m13_resolve_social", "m20_dense_ids",
    "m21_violations", "p06_title", "p15_link_preview", "p20_drop_noise", "p21_refresh_due", "s01_current_status",
    "s02_refresh_due_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session.build(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        begin = time.perf_counter()
        result = queries[name](spark, folder)
        if name.startswith("r"):
            result.collect()
        else:
            result.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    for _ in range(2):
        for name in names:
            run(name)
    times = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in names}
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
