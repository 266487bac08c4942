"""Optional predicates: date windows, status, ids and free-text search."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(df: DataFrame, column: str, start=None, end=None, whole_end_day: bool = False) -> DataFrame:
    """Rows whose timestamp lies in [start, end].

    A ``date`` bound means its midnight, so by default the end day counts only at 00:00:00;
    ``whole_end_day`` takes all of it.
    """
    if start is not None:
        df = df.filter(F.col(column) >= moment(start))
    if end is not None and whole_end_day:
        df = df.filter(F.col(column) < moment(date(end.year, end.month, end.day) + timedelta(days=1)))
    elif end is not None:
        df = df.filter(F.col(column) <= moment(end))
    return df


def moment(value) -> Column:
    """A date or datetime as a zone-free timestamp literal."""
    text = value.isoformat(sep=" ") if hasattr(value, "hour") else f"{value.isoformat()} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def having_ids(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows for the given keys: all of them (None), a short list, or a DataFrame of keys of any size."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def search(df: DataFrame, columns: list[str], text: str | None, ignore_accents: bool = False) -> DataFrame:
    """Rows where any column contains ``text``, ignoring case.

    The plain form keeps ``%`` and ``_`` as wildcards and takes a backslash literally; the accent-blind form takes all literally.
    """
    if text is None:
        return df
    if ignore_accents:
        hits = [F.collate(F.col(c), "UNICODE_CI_AI").contains(F.collate(F.lit(text), "UNICODE_CI_AI")) for c in columns]
    else:
        pattern = text.lower().replace("\\", "\\\\")
        hits = [F.lower(c).like(f"%{pattern}%") for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def page(df: DataFrame, order: list, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of an ordered listing; plans as a single top-k, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)

