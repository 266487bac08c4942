"""The registered queries of the text operators and their checking SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["corpus_queries", "dedup_queries", "quality_queries", "token_queries", "url_queries"]


def _family(attribute: str) -> dict:
    merged: dict = {}
    for name in FAMILIES:
        merged.update(getattr(import_module(f"storelytics.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    return _family("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _family("ORACLE")
