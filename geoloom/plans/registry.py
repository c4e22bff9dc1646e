"""Queries by name, each with its SQL, and the rounding that both sides share.

Floats are rounded alike on both sides, since sums depend on their order in the
last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def near(column: Column | str, digits: int = 4) -> Column:
    return F.round(column, digits) + 0.0


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, negative zero made zero."""
    return df.select(*[near(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
