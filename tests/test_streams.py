"""A stream in any split of the input equals the batch job, and a batch run again changes nothing."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storelytics.operators.outbox import status_outbox
from storelytics.operators.refresh import refresh_due
from storelytics.sources.bound import BINDINGS
from storelytics.streaming.outbox import outbox_stream
from storelytics.streaming.refresh import refresh_due_stream
from storelytics.streaming.replay import batch_writer, parquet_stream
from storelytics.streaming.status import current_status, current_status_stream, merge_status, read_status


@pytest.fixture(scope="module", params=[1, 4])
def replay(request, tables, tmp_path_factory):
    """The event table in time order over a number of files, as a stream of one file per batch."""
    folder = tmp_path_factory.mktemp("events")
    events = tables.raw("events").toPandas().sort_values("ts")
    size = -(-len(events) // request.param)
    for i in range(request.param):
        path = folder / f"part-{i}.parquet"
        events.iloc[i * size:(i + 1) * size].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (time.time() - 1000 + i * 10,) * 2)

    def run(binding, job):
        stream = parquet_stream(tables.spark, str(folder), tables.raw("events").schema, files_per_batch=1)
        out = tmp_path_factory.mktemp("out")
        return job(tables.spark, tables.sql(BINDINGS[binding], events=stream), str(out / "table"), str(out / "progress"))

    return run


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_status(replay, tables):
    assert same(current_status(tables.order_history), replay("order_history", current_status_stream))


def test_status_reads_one_version_of_each_order(spark, tables, tmp_path):
    """Batches in any order and run twice: same table, two versions of a bucket at most, one row per order read."""
    table, history = str(tmp_path / "t"), tables.order_history
    write = merge_status(table, buckets=4)
    for number, part in enumerate((2, 0, 3, 1)):
        rows = history.filter(F.col("history_id") % 4 == part)
        write(rows, number)
        before = sorted(map(tuple, read_status(spark, table).collect()))
        write(rows, number)
        assert sorted(map(tuple, read_status(spark, table).collect())) == before
    assert same(current_status(history), read_status(spark, table))
    assert sum(1 for _ in Path(table).glob("batch=*/bucket=*")) <= 8
    read = read_status(spark, table)
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) == 4 and all("batch=3" in f for f in read.inputFiles())


def test_status_leaves_other_buckets_alone(spark, tables, tmp_path):
    table, write = str(tmp_path / "t"), merge_status(str(tmp_path / "t"), buckets=8)
    write(tables.order_history, 0)
    write(tables.order_history.limit(1), 1)
    assert sum(1 for _ in Path(table).glob("batch=1/bucket=*")) == 1
    assert same(current_status(tables.order_history), read_status(spark, table))


def test_refresh(replay, tables):
    assert same(refresh_due(tables.url_requests), replay("url_requests", refresh_due_stream))


def test_refresh_out_of_order(tables, tmp_path):
    """Files in any order give what the table gives, as long as the watermark waits for them; state is not written out."""
    events = tables.raw("events").toPandas().sort_values("ts")
    span = (events.ts.max() - events.ts.min()).total_seconds()
    (tmp_path / "in").mkdir()
    for i, part in enumerate((2, 0, 3, 1)):
        path = tmp_path / f"in/part-{i}.parquet"
        events.iloc[part * 250:(part + 1) * 250].sample(frac=1, random_state=i).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (time.time() - 1000 + i * 10,) * 2)
    last = events.iloc[[0]].assign(ts=events.ts.max() + (events.ts.max() - events.ts.min()) * 2, user_id=-1)
    last.to_parquet(tmp_path / "in/part-9.parquet", coerce_timestamps="us")  # what lets the watermark pass the rest
    stream = parquet_stream(tables.spark, str(tmp_path / "in"), tables.raw("events").schema, files_per_batch=1)
    requests = tables.sql(BINDINGS["url_requests"], events=stream)
    kept = refresh_due_stream(tables.spark, requests, f"{tmp_path}/out/t", f"{tmp_path}/out/p", delay=f"{int(span) + 1} seconds")
    assert same(refresh_due(tables.url_requests), kept.filter("url NOT LIKE '%/-1'"))
    assert all(f.startswith("batch=") for f in os.listdir(f"{tmp_path}/out/t"))


def test_outbox(replay, tables):
    assert same(status_outbox(tables.status_changes), replay("status_changes", outbox_stream))


def test_writing_a_batch_again_replaces_it(spark, tmp_path):
    write = batch_writer(str(tmp_path / "t"))
    write(spark.range(3), 0)
    write(spark.range(5), 1)
    write(spark.range(5), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_empty_stream(tables, tmp_path):
    (tmp_path / "none").mkdir()
    spark = tables.spark
    for binding, job in (("order_history", current_status_stream), ("url_requests", refresh_due_stream), ("status_changes", outbox_stream)):
        stream = parquet_stream(spark, str(tmp_path / "none"), tables.raw("events").schema)
        rows = job(spark, tables.sql(BINDINGS[binding], events=stream), str(tmp_path / binding), str(tmp_path / f"{binding}-progress"))
        assert rows.count() == 0


def test_refresh_goes_on_after_a_restart(tables, tmp_path):
    """Files that arrive after the first run are judged by what that run kept."""
    spark = tables.spark
    events = tables.raw("events").toPandas().sort_values("ts")
    (tmp_path / "in").mkdir()
    for i, part in enumerate((events.iloc[:400], events.iloc[400:])):
        part.to_parquet(tmp_path / "in" / f"part-{i}.parquet", coerce_timestamps="us")
        stream = parquet_stream(spark, str(tmp_path / "in"), tables.raw("events").schema)
        requests = tables.sql(BINDINGS["url_requests"], events=stream)
        kept = refresh_due_stream(spark, requests, str(tmp_path / "table"), str(tmp_path / "progress"))
    assert same(refresh_due(tables.url_requests), kept)
