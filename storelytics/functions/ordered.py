"""Order within keys of any size: rows are sorted by ranges once, and what one range needs to know of another is carried over.

Ranges ignore where keys begin and end, so a key that owns a third of the table lies in a third of the ranges. What is known of
a key's rows in a range is one row of a small table; sums or extremes of that over the ranges before or after give the carry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from storelytics.session import cut

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's place in its partition


def ranged(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` sorted by ``order`` over ranges: ``_piece`` is the range, ``_at`` the place in it. Written, so that all jobs see the same."""
    place = F.monotonically_increasing_id()
    return cut(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_piece": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit(_ROW_BITS))})
    )


def earlier_pieces(rows: DataFrame, key: list[str], of_piece: Column, over: Callable[[Column], Column]) -> DataFrame:
    """(key, _piece, _first, _earlier): a piece's first place, and ``of_piece`` put together by ``over`` over the key's earlier pieces."""
    return _carried(rows, key, of_piece, over, F.col("_piece").asc(), "_earlier")


def later_pieces(rows: DataFrame, key: list[str], of_piece: Column, over: Callable[[Column], Column]) -> DataFrame:
    """(key, _piece, _first, _later): the same over the key's later pieces."""
    return _carried(rows, key, of_piece, over, F.col("_piece").desc(), "_later")


def _carried(rows: DataFrame, key: list[str], of_piece: Column, over, order: Column, name: str) -> DataFrame:
    known = rows.groupBy(*key, "_piece").agg(of_piece.alias("_known"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn(name, over(F.col("_known")).over(before)).drop("_known")
