"""Where queries are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
found: dict[str, Query] = {}


def query(f: Query) -> Query:
    found[f.__name__] = f
    return f
