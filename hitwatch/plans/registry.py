"""The registered queries with their DuckDB twins, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def slots(df: DataFrame, key: str, column: str, digits: int = 6) -> DataFrame:
    """(key, slot, value) of an array column."""
    return df.select(key, F.posexplode(column).alias("slot", "value")).select(key, "slot", F.round("value", digits).alias("value"))
