"""Current status per order, folded from the history log.

The stream keeps a table of one row per order in buckets of the order's hash. A batch is reduced to its latest row per order; only the
buckets it touches are read, merged and written again, as a new version in the batch's own folder. The version before stays until the next
batch, so a batch that is run again reads what it read the first time and replaces what it wrote. A reader takes the newest version of
each bucket and nothing else. At most two versions of a bucket exist, however many batches there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.streaming.replay import batch_path, drop_path, folders, run_batches

BUCKETS = 32
STATUS = "order_id long, status string, updated_at timestamp_ntz"
_MERGED = "order_id long, _last struct<updated_at: timestamp_ntz, history_id: bigint, status: string>"


def _latest(history: DataFrame) -> DataFrame:
    return history.groupBy("order_id").agg(F.max(F.struct("updated_at", "history_id", "status")).alias("_last"))


def _plain(latest: DataFrame) -> DataFrame:
    return latest.select("order_id", F.col("_last.status").alias("status"), F.col("_last.updated_at").alias("updated_at"))


def current_status(history: DataFrame) -> DataFrame:
    """The latest status of each order: an aggregate with a fixed-size state per order that combines before the shuffle."""
    return _plain(_latest(history))


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The batches that wrote a version of each bucket, oldest first, from folder names alone."""
    found: dict[int, list[int]] = {}
    for batch, bucket in folders(spark, table, "batch", "bucket"):
        found.setdefault(bucket, []).append(batch)
    return {bucket: sorted(batches) for bucket, batches in found.items()}


def _read(spark: SparkSession, table: str, newest: dict[int, int]) -> DataFrame:
    paths = [f"{batch_path(table, batch)}/bucket={bucket}" for bucket, batch in sorted(newest.items())]
    return spark.read.schema(_MERGED).parquet(*paths) if paths else spark.createDataFrame([], _MERGED)


def merge_status(table: str, buckets: int = BUCKETS):
    """The writer of one batch: (history rows, batch number) into the table's touched buckets."""

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        versions = _versions(spark, table)
        changed = _latest(rows).withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int")).persist()
        try:
            # No more numbers than there are buckets.
            touched = [r.bucket for r in changed.select("bucket").distinct().collect()]
            before = {b: max(v for v in versions[b] if v < number) for b in touched if any(v < number for v in versions.get(b, []))}
            known = _read(spark, table, before).withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int"))
            merged = changed.unionByName(known).groupBy("order_id", "bucket").agg(F.max("_last").alias("_last"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(batch_path(table, number))
        finally:
            changed.unpersist()
        for bucket, batches in versions.items():
            for old in [v for v in batches if v < number][:-1]:
                drop_path(spark, f"{batch_path(table, old)}/bucket={bucket}")

    return step


def read_status(spark: SparkSession, table: str) -> DataFrame:
    """The current status of each order: the newest version of each bucket."""
    return _plain(_read(spark, table, {bucket: batches[-1] for bucket, batches in _versions(spark, table).items()}))


def current_status_stream(spark: SparkSession, history: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """Merge a history stream into the table at ``target`` and give the current status of each order."""
    run_batches(history.select("order_id", "updated_at", "history_id", "status"), checkpoint, merge_status(target, buckets))
    return read_status(spark, target)
