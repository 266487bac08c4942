"""All registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from storelytics.session import tune
from storelytics.sources.bound import Tables

FAMILIES = ["report_queries", "listing_queries", "change_queries", "preview_queries", "stream_queries"]


def _family(attribute: str) -> dict:
    merged: dict = {}
    for name in FAMILIES:
        merged.update(getattr(import_module(f"storelytics.plans.{name}"), attribute))
    return merged


def _runner(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Tables(tune(spark), folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _runner(build) for key, build in _family("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _family("ORACLE")
