"""Notifications from a stream of status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelytics.operators.outbox import status_outbox
from storelytics.streaming.replay import batch_writer, prepare, run_batches, written

OUTBOX = "notification_id string, topic string, title string, body string, data string"


def outbox_stream(spark: SparkSession, changes: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """One notification per change. Ids derive from the change, and a batch run again replaces its own folder."""
    prepare(spark, target, OUTBOX)
    run_batches(status_outbox(changes), checkpoint, batch_writer(target))
    return written(spark, target, OUTBOX).drop("batch")
