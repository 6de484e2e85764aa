"""Query registry and result presentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
NUDGE = 3e-10
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: present(build(spark, sf))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded past summation noise, dates as text.

    The nudge settles exact ties, which engines round either way; adding 0.0
    turns a negative zero into zero.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column + F.lit(NUDGE), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rounded(sql: str, doubles: str, others: str = "") -> str:
    """Outer SELECT of a check: doubles rounded as `present` rounds them."""
    parts = [c.strip() for c in others.split(",") if c.strip()]
    parts += [f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(parts)} FROM ({sql})"
