"""Registry of named queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL twin when there is one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def settle(df: DataFrame) -> DataFrame:
    """Result types both engines agree on: bigint, double rounded to six places, text, boolean."""
    shaped = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(F.flatten(c) if isinstance(field.dataType.elementType, T.ArrayType) else c, ",", "null")
        shaped.append(c.alias(field.name))
    return df.select(*shaped)


def r6(expression: str) -> str:
    """SQL for a double rounded to six places."""
    return f"round(({expression})::double, 6)"


def big(expression: str) -> str:
    """SQL for a bigint."""
    return f"({expression})::bigint"
