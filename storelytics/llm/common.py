"""Helpers shared by the text operators: settings, cut lineage, word columns, worker memory."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelytics import session

# Words parted by ASCII white space, as the digests define them.
SPACE_WORDS = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Drops a query's shuffle files when it has ended instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CONF = {
    # Texts are wide; bound what one Arrow batch holds by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


def tune(spark: SparkSession) -> SparkSession:
    session.tune(spark)
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no more than their own tasks.

    What was shuffled on the way is not needed again and is dropped with the end of the write.
    """
    with dropped_shuffles(df.sparkSession):
        return session.cut(df)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run within drop their shuffle files when they end."""
    conf = spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def ascii_lower(text) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def memo(name: str) -> dict:
    """A dictionary that outlives the task in its Python worker. Callers bound its size."""
    holder = sys.modules.setdefault("storelytics_worker_memo", types.ModuleType("storelytics_worker_memo"))
    return holder.__dict__.setdefault(name, {})
