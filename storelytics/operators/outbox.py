"""Notifications to be sent, as rows; sending them is left to a delivery service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelytics.functions.nest import as_json
from storelytics.operators.decisions import refused_row


def _topic(user: str):
    return F.concat(F.lit("userId_"), F.col(user).cast("string"))


def status_outbox(changes: DataFrame) -> DataFrame:
    """One notification per status change (change_id, order_id, customer_id, status, description, at)."""
    data = F.struct(
        F.lit("order").alias("type"), F.col("order_id").cast("string").alias("order_id"), _stamp().alias("timestamp")
    )
    return changes.select(
        F.concat(F.lit("order-"), F.col("change_id").cast("string")).alias("notification_id"),
        _topic("customer_id").alias("topic"),
        F.concat(F.lit("Order "), F.col("status")).alias("title"),
        F.col("description").alias("body"),
        as_json(data).alias("data"),
    )


def _stamp():
    return F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def request_outbox(decisions: DataFrame) -> DataFrame:
    """Notifications for decided request masters: one per rejected request, or a single one when none was rejected.

    A master that ``decision_rollup`` refuses, for a row without its request or with another status, gets none.
    ``decisions``: request_master_id, user_id, request_id, status, product_name, admin_remarks, customer_email,
    customer_name, at.
    """
    masters = decisions.groupBy("request_master_id").agg(
        F.count_if(refused_row()).alias("_bad"),
        F.count_if(F.col("status") == "Rejected").alias("_rejected"),
        *[F.max(c).alias(c) for c in ("user_id", "customer_email", "customer_name", "at")],
    )
    masters = masters.filter(F.col("_bad") == 0)
    rejected = decisions.filter(F.col("status") == "Rejected")
    refused = rejected.join(masters.select("request_master_id"), "request_master_id", "left_semi").select(
        F.concat_ws("-", F.lit("rejected"), "request_master_id", "request_id").alias("notification_id"),
        "request_master_id", "user_id", "customer_email", "customer_name", "at",
        _text("product_name").alias("product_name"), _text("admin_remarks").alias("admin_remarks"),
        F.coalesce(_filled("product_name"), _filled("admin_remarks"), F.lit("NA")).alias("body"),
        F.lit("rejected").alias("_word"),
    )
    granted = masters.filter(F.col("_rejected") == 0).select(
        F.concat_ws("-", F.lit("approved"), "request_master_id").alias("notification_id"),
        "request_master_id", "user_id", "customer_email", "customer_name", "at",
        F.lit("").alias("product_name"), F.lit("").alias("admin_remarks"), F.lit("").alias("body"),
        F.lit("approved").alias("_word"),
    )
    data = F.struct(
        F.col("request_master_id").cast("string").alias("request_id"),
        _text("customer_email").alias("customer_email"), _text("customer_name").alias("customer_name"),
        "product_name", "admin_remarks", F.lit("product_request").alias("type"), _stamp().alias("timestamp"),
    )
    title = F.concat(
        F.lit("Your Product Request #"), F.col("request_master_id").cast("string"), F.lit(" has been "), F.col("_word"), F.lit(".")
    )
    return refused.unionByName(granted).select(
        "notification_id", _topic("user_id").alias("topic"), title.alias("title"), "body", as_json(data).alias("data")
    )


def _text(column):
    return F.coalesce(column, F.lit(""))


def _filled(column):
    return F.nullif(F.col(column), F.lit(""))


def outbox_counts(results: DataFrame) -> DataFrame:
    """Sent and failed notifications per group, from rows (request_master_id, notification_sent)."""
    sent = F.coalesce("notification_sent", F.lit(False))
    return results.groupBy("request_master_id").agg(
        F.count_if(sent).alias("total_sent"), F.count_if(~sent).alias("total_failed")
    )
