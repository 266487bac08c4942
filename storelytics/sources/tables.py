"""Logical tables at rest: parquet folders by version, each named by a pointer of its own that is written last.

A job that changes a table reads the current version and publishes the next one; readers see the old rows
until the new ones are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelytics.schemas import TABLES


def publish(df: DataFrame, root: str, name: str, version: int, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as a version of the table and make it the current one, unless a higher version is there.

    Pointers are only ever added, so a reader finds the old or the new one at any time.
    """
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{root}/{name}/version={version}")
    pointer = df.sparkSession.range(1).select(F.lit(version).cast("long").alias("version"))
    pointer.write.mode("append").parquet(f"{root}/{name}/current")


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version of a table, with its stated schema where the table is a known one."""
    version = spark.read.schema("version long").parquet(f"{root}/{name}/current").agg(F.max("version")).first()[0]
    path = f"{root}/{name}/version={version}"
    if name not in TABLES:
        return spark.read.parquet(path)
    rows = spark.read.schema(TABLES[name]).parquet(path)
    return rows.select(*T.StructType.fromDDL(TABLES[name]).names)  # partition columns come last otherwise
