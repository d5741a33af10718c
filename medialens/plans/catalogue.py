"""The registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("images", "labels", "clusters", "regions", "serving", "evaluation", "ingest", "search", "extras", "media", "views", "tables")


def _all() -> dict[str, tuple[Query, str | None]]:
    return {name: pair for family in FAMILIES for name, pair in import_module(f"medialens.plans.{family}").QUERIES.items()}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
