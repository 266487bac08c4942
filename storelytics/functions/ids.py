"""Consecutive surrogate ids without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from storelytics.session import cut

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's place in its partition


def dense_ids(rows: DataFrame, name: str, order: list, start=0) -> DataFrame:
    """Number rows ``start + 1, start + 2, ...`` in ``order``.

    Rows are range-sorted, so each partition needs only the row count of those before it: a table of one
    row per partition. The sorted rows are written out first, because counts and numbers must see the
    same partitions even if an executor is lost in between. ``start`` is a number or a one-row
    DataFrame of the highest id in use.
    """
    sorted_rows = cut(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = F.coalesce(start.scalar(), F.lit(0)) if isinstance(start, DataFrame) else F.lit(start)
    number = first + F.col("_offset") + F.col("_row") + 1
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, number.cast(T.LongType()))
        .drop("_part", "_row", "_offset")
    )


def highest(table: DataFrame, column: str) -> DataFrame:
    """One-row DataFrame of the highest id in use, for ``dense_ids(start=...)``."""
    return table.agg(F.max(column).alias("_start"))
