"""Registered streaming queries: each replays the driver's event table as a stream, in one or more batches."""

from storelytics.plans.change_queries import ORACLE as CHANGE_ORACLE
from storelytics.plans.preview_queries import ORACLE as PREVIEW_ORACLE
from storelytics.plans.report_queries import with_tables
from storelytics.session import scratch_path
from storelytics.sources.bound import BINDINGS
from storelytics.streaming.outbox import outbox_stream
from storelytics.streaming.refresh import refresh_due_stream
from storelytics.streaming.replay import parquet_stream
from storelytics.streaming.status import current_status, current_status_stream


def _replay(t, binding, job):
    events = parquet_stream(t.spark, f"{t.folder}/events.parquet", t.raw("events").schema)
    target = scratch_path(t.spark, binding)
    return job(t.spark, t.sql(BINDINGS[binding], events=events), target, scratch_path(t.spark, f"{binding}-progress"))


QUERIES = {
    "s01_current_status": lambda t: current_status(t.order_history),
    "s01_current_status_stream": lambda t: _replay(t, "order_history", current_status_stream),
    "s02_refresh_due_stream": lambda t: _replay(t, "url_requests", refresh_due_stream),
    "s03_outbox_stream": lambda t: _replay(t, "status_changes", outbox_stream),
}

_STATUS = with_tables(
    "order_history",
    """SELECT order_id, status, updated_at FROM t_order_history
    QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, history_id DESC) = 1""",
)

ORACLE = {
    "s01_current_status": _STATUS,
    "s01_current_status_stream": _STATUS,
    "s02_refresh_due_stream": PREVIEW_ORACLE["p21_refresh_due"],
    "s03_outbox_stream": CHANGE_ORACLE["m19_outbox"],
}
