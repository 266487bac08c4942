"""Reducing several changes of one key to the one that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``; an aggregate, so it combines before the shuffle."""
    return _pick(changes, keys, order, F.max)


def first_per_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(changes, keys, order, F.min)


def _pick(changes, keys, order, pick):
    rest = [c for c in changes.columns if c not in keys and c not in order]
    best = changes.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in changes.columns if c not in keys])
