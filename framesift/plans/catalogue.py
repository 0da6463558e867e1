"""The query catalogue over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("prediction", "layout", "pixels", "bytes", "codecs", "streams", "media", "analysis")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in import_module(f"framesift.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for m in MODULES for k, v in import_module(f"framesift.plans.{m}").SQL.items()}
