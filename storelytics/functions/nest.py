"""Child rows gathered into ordered arrays without ever building an unbounded one.

Each child has a place in its key's order; ``part`` is the place divided by the rows a part may hold,
and each part is one array. Parts in order of ``part`` joined end to end are the whole array, nothing dropped, nothing
moved. A key that owns a third of the table becomes many parts in many tasks.

A key of few rows, all of one part, is one group of a shuffle by key: its rows are collected and put in order there. Which keys have more
is counted first. Only the rows of those busy keys are laid out by ranges, and all keys' arrays together are the result.

Places of busy keys come from one range sort of their rows by key and order. A row's place is its place in its range, less where the key begins
there, plus what earlier ranges hold of the key: a row per key and range. Ranges have equal numbers of rows whatever the keys, the
order columns or their NULLs are, so no task ranks or gathers more than a range or a part of a busy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from storelytics.functions.ordered import earlier_pieces, ranged
from storelytics.session import cut

ARRAY_ROWS = 100_000
LIGHT_ROWS = 10_000  # keys of more rows are laid out by ranges; an aggregate may hold some hundred keys of a task at once


def gather(
    rows: DataFrame, key: str, order: list[str], value: Column, name: str, array_rows: int = ARRAY_ROWS, weight: Column | None = None
) -> DataFrame:
    """(key, part, name): ``value`` of each row as an array in ``order`` (ties by value), NULL values kept.

    A part holds ``array_rows`` rows, or rows that weigh as much where ``weight`` says so; a heavier row is a part of its own.
    """
    heavy = [] if weight is None else [weight.cast("long").alias("_weight")]
    entries = rows.filter(F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], value.alias("_value"), *heavy)
    # Nested values may be large, and samples of the sort columns go to the driver: they are told apart by a hash.
    nested = isinstance(entries.schema["_value"].dataType, (T.StructType, T.ArrayType, T.MapType))
    tie = F.xxhash64("_value") if nested else F.col("_value")
    # Weighing reads the nested values themselves, so those are computed once and written.
    entries = entries.withColumn("_tie", tie) if weight is None else cut(entries.withColumn("_tie", tie))
    order_of = [f"_o{i}" for i in range(len(order))]
    many = F.count("*") > min(array_rows, LIGHT_ROWS)
    many = many if weight is None else many | F.coalesce(F.sum("_weight") >= array_rows, F.lit(False))
    busy = cut(entries.groupBy(key).agg(many.alias("_many")).filter("_many").select(key))
    none = busy.isEmpty()
    light = entries if none else entries.join(busy, key, "left_anti")
    entry = F.struct(*order_of, *(["_tie"] if nested else []), "_value")
    # Dealt by key before the aggregate: its first half would sort, and spill, whole input splits in vain.
    collected = light.repartition(key).groupBy(key).agg(values(F.sort_array(F.collect_list(entry))).alias(name))
    few = collected.select(key, F.lit(0).cast("long").alias("part"), name)
    if none:
        return few
    return few.unionByName(_laid_out(entries.join(busy, key, "left_semi"), key, [*order_of, "_tie"], name, array_rows, weight is not None))


def _laid_out(entries: DataFrame, key: str, places: list[str], name: str, array_rows: int, weighed: bool) -> DataFrame:
    """(key, part, name) of ``entries`` (key, places, _value, _weight if ``weighed``), by ranges of all rows."""
    laid = ranged(entries, [key, *places]).select(key, "_piece", "_at", "_value", *(["_weight"] if weighed else []))
    if not weighed:
        before = earlier_pieces(laid, [key], F.count("*"), F.sum)
        inside = F.col("_at") - F.col("_first")
    else:
        before = earlier_pieces(laid, [key], F.sum("_weight"), F.sum)
        preceding = Window.partitionBy(key, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        laid = laid.withColumn("_inside", F.coalesce(F.sum("_weight").over(preceding), F.lit(0)))
        inside = F.col("_inside")
    place = inside + F.coalesce("_earlier", F.lit(0))
    entry = F.struct("_piece", "_at", "_value")

    def arrays(of: DataFrame, *by: str) -> DataFrame:
        placed = laid.join(of, [key, "_piece"]).withColumn("part", F.floor(place / array_rows))
        return placed.groupBy(*by).agg(values(F.sort_array(F.collect_list(entry))).alias(name)).select(key, "part", name)

    # A key within one range is gathered where the join has put it; the keys that go on in the next range, one per range at most, are dealt by part.
    before = before.withColumn("_ranges", F.count("*").over(Window.partitionBy(key)))
    whole, going_on = before.filter("_ranges = 1"), before.filter("_ranges > 1")
    return arrays(whole, key, "_piece", "part").unionByName(arrays(going_on, key, "part"))


def values(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["_value"])


def attach(parents: DataFrame, arrays: DataFrame, key: str, name: str, empty: bool = True) -> DataFrame:
    """Left join of gathered arrays; a parent without children gets ``[]``, or NULL when ``empty`` is False.

    The arrays are partitioned by key already, so a merge join moves only the parents. It is asked for because
    the planner takes arrays for much smaller than they are and would broadcast them.
    """
    joined = parents.join(arrays.hint("merge"), key, "left").withColumn("part", F.coalesce("part", F.lit(0)).cast("int"))
    if empty:
        joined = joined.withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))
    return joined


def as_json(column) -> Column:
    """JSON text of an array or struct, null fields kept."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def joined_text(column: str, separator: str = ", ") -> Column:
    return F.array_join(column, separator)
