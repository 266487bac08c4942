"""First-come claims to unique values, settled as if one by one.

A row claims several values at once and is accepted only if none of them belongs to another owner; a refused row holds nothing. Whether a row
is accepted therefore depends on the fate of earlier rows, which no window expresses. It is settled in rounds instead: a row that
is the earliest open claimant of all its values cannot be beaten any more and is accepted, rows that share a value with an accepted
row of another owner are refused, and the rest goes on. Every round settles all rows it can by aggregates and joins, however many want one
value; the number of rounds is the length of the longest chain of rows that wait for each other, not the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelytics.session import cut

BLIND = "UNICODE_CI_AI"


def blind(column) -> Column:
    """Text as a key that neither case nor accents tell apart."""
    return F.collate(F.col(column) if isinstance(column, str) else column, BLIND)


def matched(rows: DataFrame, found: DataFrame, value: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``found`` on a ``blind`` value, as a shuffled hash join that holds ``found``.

    A merge join would sort by the collation key, which Spark computes anew for both sides of every comparison; rows that share
    their first letters, and above all one value that many rows have, cost that a logarithm of times. Here a row's key is computed once
    for the shuffle and once for the lookup. ``found`` is the side with one row per value, or few.
    """
    return rows.join(found.hint("shuffle_hash"), value, how)


def owners(claims: DataFrame, at: str, who: str, values: list[str]) -> dict[str, DataFrame]:
    """Who gets each value: per column of ``values`` a table (value, _at, _who), ``_at`` being the row that took it.

    ``claims`` are rows told apart and ordered by ``at``, each for an owner ``who``; a NULL value claims nothing. An owner may claim
    what it has.
    """
    names = list(dict.fromkeys([at, who]))  # rows may own what they claim themselves
    left = cut(claims.select(*names, *values))
    taken: dict[str, list[DataFrame]] = {v: [] for v in values}
    while True:
        marked, earliest = left, []
        for v in values:
            first = left.filter(F.col(v).isNotNull()).groupBy(v).agg(F.min(at).alias(f"_first_{v}"))
            marked = matched(marked, first, v)
            earliest.append(F.col(v).isNull() | (F.col(f"_first_{v}") == F.col(at)))
        won = reduce(lambda a, b: a & b, earliest)
        judged = cut(marked.select(*names, *values, won.alias("_won")))
        winners, rest = judged.filter("_won"), judged.filter("NOT _won")
        refused = F.lit(False)
        for v in values:
            got = winners.filter(F.col(v).isNotNull()).select(v, F.col(at).alias("_at"), F.col(who).alias("_who"))
            taken[v].append(got)
            rest = matched(rest, got.select(v, F.col("_who").alias(f"_who_{v}")), v)
            refused |= F.coalesce(F.col(f"_who_{v}") != F.col(who), F.lit(False))
        # What a row's own owner has got needs no claim any more.
        open_values = [F.when(F.col(f"_who_{v}").isNull(), F.col(v)).alias(v) for v in values]
        left = cut(rest.filter(~refused).select(*names, *open_values))
        if left.isEmpty():
            return {v: reduce(DataFrame.unionByName, parts) for v, parts in taken.items()}


def held_before(rows: DataFrame, found: dict[str, DataFrame], at: str, who: str) -> DataFrame:
    """``rows`` with ``_held_<value>``: whether an earlier accepted claim of another owner has the value."""
    for v, table in found.items():
        of = table.select(v, F.col("_at").alias("_took"), F.col("_who").alias("_has"))
        late = F.coalesce((F.col("_has") != F.col(who)) & (F.col("_took") < F.col(at)), F.lit(False))
        rows = matched(rows, of, v).withColumn(f"_held_{v}", late).drop("_took", "_has")
    return rows
