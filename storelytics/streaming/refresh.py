"""Refresh decisions on a stream of page requests, which may arrive out of order.

Each URL has its own state: from when on it may be fetched again, and the requests that wait for the watermark. A request is judged once
the watermark has passed it, so those before it have arrived; within the watermark's delay any order of arrival gives what a table of
all requests gives. What arrives later than that is dropped. A timer wakes the URL when the watermark passes its earliest waiting
request; the state of URLs without news is neither read nor written, and the kept requests of a batch are appended once.

One URL's requests are judged one after the other in one task, which holds the times of those that wait: eight bytes for each request
within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics.operators.refresh import TTL_HOURS
from storelytics.streaming.replay import batch_writer, prepare, run_batches, written

KEPT = "url string, at timestamp_ntz"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _due(wait_us: int):
    """The processor of one URL; made here so that executors need not have this package."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Due(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next_at = handle.getValueState("next_at", "us long")
            self.waiting = handle.getListState("waiting", "us long")

        def wake(self, us: int) -> None:
            # Just before the time itself, since a timer fires when the watermark is beyond it.
            self.handle.registerTimer(max(us // 1000 - 1, 0))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            times = sorted({row.us for row in rows})
            self.waiting.appendList([(us,) for us in times])
            self.wake(times[0])
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs()
            times = sorted({us for (us,) in self.waiting.get()})
            now, later = [us for us in times if us // 1000 <= passed], [us for us in times if us // 1000 > passed]
            if not now:  # another timer of the same watermark was first
                return iter(())
            held = self.next_at.get()
            due = held[0] if held else None
            kept = []
            for us in now:
                if due is None or us >= due:
                    kept.append(us)
                    due = us + wait_us
            if kept:
                self.next_at.update((due,))
            if later:
                self.waiting.put([(us,) for us in later])
                self.wake(later[0])
            else:
                self.waiting.clear()
            return iter([Row(url=key[0], us=us) for us in kept])

        def close(self) -> None:
            pass

    return Due()


def refresh_due_stream(
    spark: SparkSession, requests: DataFrame, target: str, checkpoint: str, ttl_hours: int = TTL_HOURS, delay: str = "0 seconds"
) -> DataFrame:
    """Kept requests (url, at) of the stream ``requests`` (url, at); ``delay`` is how far out of order they may arrive."""
    prepare(spark, target, KEPT)
    asked = requests.dropna().select("url", F.col("at").cast("timestamp").alias("time")).withWatermark("time", delay)
    judged = asked.withColumn("us", F.unix_micros("time")).groupBy("url").transformWithState(
        statefulProcessor=_due(ttl_hours * 3_600_000_000), outputStructType="url string, us long", outputMode="append", timeMode="EventTime"
    )
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        run_batches(judged.select("url", F.timestamp_micros("us").cast("timestamp_ntz").alias("at")), checkpoint, batch_writer(target))
    finally:
        spark.conf.set(STORE, before)
    return written(spark, target, KEPT).drop("batch")
