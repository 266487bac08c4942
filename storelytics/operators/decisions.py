"""Decisions on product requests and changes of order status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.functions.ids import dense_ids, highest
from storelytics.functions.latest import last_per_key
from storelytics.operators.upserts import overlay
from storelytics.schemas import APPROVAL_OPTIONS_JSON, ORDER_STATUS, REQUEST_STATUS

# What each action makes of a request.
OUTCOME = {"approve": "Approved", "reject": "Rejected"}
STATUS_ID = {name: key for key, name in REQUEST_STATUS.items()}
ORDER_STATUS_ID = {name: key for key, name in ORDER_STATUS.items()}
CANCELED = "Canceled"


def judge_decisions(requests, decisions) -> DataFrame:
    """Decisions with their parsed options and, where one cannot be carried out, the reason."""
    known = requests.select("request_id", F.lit(True).alias("_known"))
    no_options = F.coalesce(F.size("_options"), F.lit(0)) < 1
    no_action = ~F.coalesce(F.col("action").isin(*OUTCOME), F.lit(False))
    return (
        decisions.withColumn("_options", F.from_json("options", APPROVAL_OPTIONS_JSON))
        .join(known, "request_id", "left")
        .withColumn(
            "reason",
            F.when(no_options, "Approval options are required for approval")
            .when(F.col("_known").isNull(), "Request ID not found.")
            .when(no_action, 'Invalid action. Please specify "approve" or "reject".'),
        )
    )


def decided_requests(requests, judged) -> DataFrame:
    """Requests with the status their last valid decision gives them."""
    valid = judged.filter(F.col("reason").isNull()).select("request_id", "decision_id", "action", "at")
    last = last_per_key(valid, ["request_id"], ["decision_id"])
    approved = F.col("patch.action") == "approve"
    new = {
        "status": F.when(approved, OUTCOME["approve"]).otherwise(OUTCOME["reject"]),
        "request_status_id": F.when(approved, STATUS_ID["Approved"]).otherwise(STATUS_ID["Rejected"]),
        "updated_at": F.col("patch.at"),
    }
    return overlay(requests, last, ["request_id"], new)


def replaced_approvals(approvals, judged) -> DataFrame:
    """Approvals where the options of the last valid approval take the place of a request's earlier ones."""
    granted = judged.filter(F.col("reason").isNull() & (F.col("action") == "approve"))
    fields = ["request_id", "decision_id", "admin_id", "at", "_options"]
    chosen = last_per_key(granted.select(*fields), ["request_id"], ["decision_id"])
    options = chosen.select("request_id", "decision_id", "admin_id", "at", F.posexplode("_options").alias("pos", "option"))
    fresh = options.select(
        "decision_id", (-F.col("pos")).alias("_pos"), "request_id", F.col("admin_id").alias("approved_by"),
        F.col("option.size").alias("approved_size"), F.col("option.color").alias("approved_color"),
        F.col("option.price").alias("approved_price"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )
    numbered = dense_ids(fresh, "approval_id", ["decision_id", "_pos"], highest(approvals, "approval_id"))
    kept = approvals.join(chosen.select("request_id"), "request_id", "left_anti")
    return kept.unionByName(numbered.drop("decision_id", "_pos"), allowMissingColumns=True)


def apply_decisions(requests, approvals, decisions) -> dict[str, DataFrame]:
    """Approve or reject requests; approval replaces all options of the request.

    ``decisions``: decision_id, request_id, admin_id, action, options (JSON), at. Decisions without options, for
    unknown requests or with another action go to ``rejects`` with a reason. The last decision of a batch sets
    the status, the last approval sets the options.
    """
    judged = judge_decisions(requests, decisions)
    return {
        "requests": decided_requests(requests, judged),
        "approvals": replaced_approvals(approvals, judged),
        "rejects": rejected_decisions(judged),
    }


def rejected_decisions(judged) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select("decision_id", "request_id", "action", "reason")


def refused_row() -> Column:
    """A decision row that makes its whole master invalid."""
    return F.col("request_id").isNull() | ~F.coalesce(F.col("status").isin("Approved", "Rejected"), F.lit(False))


def decision_rollup(decisions: DataFrame) -> DataFrame:
    """Totals per request master over rows (request_master_id, request_id, status).

    A master with a row that lacks its request or has another status than Approved or Rejected is refused whole.
    """
    status = F.col("status")
    counted = decisions.groupBy("request_master_id").agg(
        F.count("*").alias("total_requests"),
        F.count_if(refused_row()).alias("_bad"),
        F.count_if(status == "Approved").alias("_approved"),
        F.count_if(status == "Rejected").alias("_rejected"),
    )
    fine = F.col("_bad") == 0

    def if_fine(column):
        return F.when(fine, F.col(column)).otherwise(0)

    return counted.select(
        "request_master_id", "total_requests",
        if_fine("total_requests").alias("processed_requests"),
        if_fine("_approved").alias("approved_count"),
        if_fine("_rejected").alias("rejected_count"),
        F.when(fine, "SUCCESS").otherwise("INVALID").alias("status"),
    )


def update_status(orders, changes, order_status) -> dict[str, DataFrame]:
    """Apply status changes (change_id, order_id, status, updated_by, at) to undeleted orders.

    Names missing from the code table go to ``rejects``. Every valid change leaves a history row, whether or
    not its order was found; the last one decides the order's status.
    """
    names = order_status.select(F.lower("status_name").alias("_name"), F.col("order_status_id"))
    resolved = changes.withColumn("_name", F.lower("status")).join(names, "_name", "left").drop("_name")
    return _apply_status(orders, resolved)


def cancel_orders(orders, cancels) -> dict[str, DataFrame]:
    """Cancel orders: a status change to Canceled per row of ``cancels`` (change_id, order_id, updated_by, at)."""
    code = {"status": F.lit(CANCELED), "order_status_id": F.lit(ORDER_STATUS_ID[CANCELED])}
    return _apply_status(orders, cancels.withColumns(code))


def _apply_status(orders: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    valid = resolved.filter(F.col("order_status_id").isNotNull())
    fields = ["order_id", "at", "change_id", "status", "order_status_id"]
    last = last_per_key(valid.select(*fields), ["order_id"], ["at", "change_id"])
    new = {
        "status": F.col("patch.status"),
        "order_status_id": F.col("patch.order_status_id"),
        "updated_at": F.col("patch.at"),
    }
    return {
        "orders": overlay(orders, last, ["order_id"], new, only=~F.col("delete_status")),
        "history": valid.select(
            "change_id", "order_id", "status", "order_status_id", "updated_by", F.col("at").alias("updated_at")
        ),
        "rejects": resolved.filter(F.col("order_status_id").isNull()).select(
            "change_id", "order_id", "status", F.lit("Invalid status provided").alias("reason")
        ),
    }
