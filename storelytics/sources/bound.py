"""The driver's parquet tables read as the engine's logical tables.

Each binding is one SELECT in the SQL subset that Spark and the checking engine share, so both see the same
input. A customer or request master now and then hands its orders to the next key, which leaves parents
without children; status ids go missing on some orders, so the two places a status is kept disagree.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelytics.schemas import order_status
from storelytics.sources.changes import CHANGES
from storelytics.sources.webpages import PAGES

BINDINGS: dict[str, str] = {
    "users": """
        SELECT c_custkey AS user_id, c_name AS name, CAST(NULL AS STRING) AS last_name,
               CASE WHEN c_custkey % 7 <> 0 THEN lower(c_name) || '@example.com' END AS email,
               '555' || CAST(c_custkey AS STRING) AS phone,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'customer' END AS role,
               'S' || CAST(c_custkey % 4 AS STRING) AS size_preferences,
               TIMESTAMP '2023-06-01 00:00:00' AS created_at, TIMESTAMP '2023-06-01 00:00:00' AS updated_at,
               c_custkey % 11 = 0 AS delete_status
        FROM {customer}""",
    "signups": """
        SELECT event_id AS user_id, CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'customer' END AS role,
               ts AS created_at
        FROM {events} WHERE event_type = 'signup'""",
    "social_users": """
        SELECT c_custkey AS id, c_custkey AS user_id, 's' || CAST(c_custkey AS STRING) AS social_id,
               CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'apple' END AS social_type
        FROM {customer}""",
    "addresses": """
        SELECT c_custkey AS address_id, c_custkey AS user_id, c_name || ' Street' AS address_line,
               n_name AS city, CAST(NULL AS STRING) AS state, CAST(10000 + c_custkey AS STRING) AS zip_code,
               r_name AS country, c_custkey % 5 = 0 AS delete_status
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "products": """
        SELECT p_partkey AS product_id, p_name AS name, p_brand AS description,
               CASE WHEN p_partkey % 6 <> 0 THEN p_name || ' ' || CAST(p_partkey AS STRING) END AS image,
               CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size AS stock, p_type AS category,
               p_partkey % 29 = 0 AS delete_status
        FROM {part}""",
    "orders": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_custkey % 23 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
               o_custkey AS address_id,
               CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'O' THEN 'Shipped' ELSE 'Delivered' END AS status,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 1
                    WHEN o_orderstatus = 'O' THEN 3 ELSE 4 END AS order_status_id,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS scheduled_time,
               CAST(o_totalprice AS DECIMAL(12,2)) AS subtotal,
               CAST(0 AS DECIMAL(12,2)) AS service_charge, CAST(0 AS DECIMAL(12,2)) AS delivery_charge,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderdate AS created_at,
               o_orderdate AS updated_at, o_orderkey % 17 = 0 AS delete_status
        FROM {orders}""",
    "order_items": """
        SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
               l_linestatus = 'O' AS is_custom_product, l_partkey AS product_id, l_suppkey AS product_request_id,
               CASE WHEN l_linestatus = 'O' THEN l_partkey END AS approval_id,
               CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               l_returnflag = 'R' AS delete_status
        FROM {lineitem}""",
    # Requests, masters and approvals as order items refer to them ...
    "item_requests": """
        SELECT s_suppkey AS request_id, CAST(s_nationkey AS BIGINT) AS request_master_id, s_name AS product_name,
               'made to order' AS description, CAST(s_nationkey AS STRING) AS requested_size,
               CAST(NULL AS STRING) AS requested_color, 2 AS request_status_id, 'Approved' AS status,
               s_name AS image, FALSE AS delete_status
        FROM {supplier}""",
    "item_approvals": """
        SELECT p_partkey AS approval_id, p_partkey AS request_id, CAST(1 AS BIGINT) AS approved_by,
               CAST(p_size AS STRING) AS approved_size, p_brand AS approved_color,
               CAST(p_retailprice AS DECIMAL(12,2)) AS approved_price
        FROM {part}""",
    # ... and as the request listings read them.
    "request_masters": """
        SELECT c_custkey AS request_master_id, c_custkey AS user_id, 1 AS request_status_id,
               c_custkey AS address_id, 'Pending' AS status, c_custkey % 31 = 0 AS delete_status,
               TIMESTAMP '2024-01-01 08:00:00' AS created_at, TIMESTAMP '2024-01-01 08:00:00' AS updated_at,
               '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS delivery_date
        FROM {customer}""",
    "requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_custkey % 19 = 0 THEN o_custkey + 1 ELSE o_custkey END AS request_master_id,
               o_orderpriority AS product_name, 'made to order' AS description,
               CAST(o_orderkey % 6 AS STRING) AS requested_size, CAST(NULL AS STRING) AS requested_color,
               CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS request_status_id,
               CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'O' THEN 'Approved' ELSE 'Rejected' END AS status,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'img' || CAST(o_orderkey AS STRING) END AS image,
               o_orderdate AS updated_at, o_orderkey % 17 = 0 AS delete_status
        FROM {orders}""",
    "approvals": """
        SELECT l_partkey * 10 + l_linenumber AS approval_id, l_orderkey AS request_id, l_suppkey AS approved_by,
               l_returnflag AS approved_size, l_linestatus AS approved_color,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS approved_price
        FROM {lineitem}""",
    "order_history": """
        SELECT event_id AS history_id, user_id AS order_id, event_type AS status,
               CAST(NULL AS INT) AS order_status_id, ts AS updated_at, CAST(NULL AS BIGINT) AS updated_by
        FROM {events}""",
    "status_changes": """
        SELECT event_id AS change_id, user_id AS order_id, user_id AS customer_id,
               CASE event_type WHEN 'click' THEN 'Processed' WHEN 'view' THEN 'Shipped'
                    WHEN 'purchase' THEN 'Delivered' WHEN 'signup' THEN 'Pending' ELSE 'Lost' END AS status,
               props AS description, CAST(1 AS BIGINT) AS updated_by, ts AS at
        FROM {events}""",
    "url_requests": """
        SELECT 'https://example.com/' || CAST(user_id AS STRING) AS url, ts AS at FROM {events}""",
    "log_lines": "SELECT doc_id AS log_id, text FROM {documents}",
    # Two thirds of the lines end in a phrase of no information, written in another case than the list has it.
    "noisy_lines": """
        SELECT doc_id AS log_id, 'line ' || CAST(doc_id AS STRING) || CASE doc_id % 18
               WHEN 0 THEN ' NET::err_failed x' WHEN 1 THEN ' failed TO fetch' WHEN 2 THEN ' preloaded using LINK preload '
               WHEN 3 THEN ' Failed to load Resource: 404' WHEN 4 THEN ' track&report' WHEN 5 THEN ' webgl lost'
               WHEN 6 THEN ' metric emission failed' WHEN 7 THEN ' Error on eTracker' WHEN 8 THEN ' typeerror: failed to fetch'
               WHEN 9 THEN ' warning -- Sushi response' WHEN 10 THEN ' MSAvowelsJavascriptAssets' WHEN 11 THEN ' Failed to fetc'
               WHEN 12 THEN ' web gl' ELSE ' fine' END AS text
        FROM {documents}""",
}

BINDINGS.update(CHANGES)
BINDINGS.update(PAGES)

# The driver's tables. Stating them saves a schema-inference job per table read.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


class Tables:
    """Logical tables over one folder of driver parquet, each read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._bound: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run a shared SELECT whose ``{name}`` slots stand for driver tables or the given frames."""
        for name in DRIVER_SCHEMAS:
            if name not in frames and "{" + name + "}" in text:
                frames[name] = self.raw(name)
        rows = self.spark.sql(text, **frames)
        zoned = [f.name for f in rows.schema if isinstance(f.dataType, T.TimestampType)]
        return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else rows

    def table(self, name: str) -> DataFrame:
        if name not in self._bound:
            self._bound[name] = self.sql(BINDINGS[name])
        return self._bound[name]

    @cached_property
    def order_status(self) -> DataFrame:
        return order_status(self.spark)

    def __getattr__(self, name: str) -> DataFrame:
        """A bound table by its name."""
        if name in BINDINGS:
            return self.table(name)
        raise AttributeError(name)


def oracle_ctes(*names: str) -> str:
    """The same bindings as common table expressions ``t_<name>`` over the driver's own views."""
    tables = {name: name for name in DRIVER_SCHEMAS}
    return ",\n".join(f"t_{name} AS ({BINDINGS[name].format(**tables)})" for name in names)
