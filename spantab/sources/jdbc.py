"""Id-range reads of a database table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def id_range_predicates(key: str, size: int, n: int) -> list[str]:
    """WHERE clauses of the ranges 0…n inclusive, ``size`` ids each."""
    return [f"{key} BETWEEN {i * size} AND {(i + 1) * size - 1}" for i in range(n + 1)]


def read_id_ranges(
    spark: SparkSession, url: str, table: str, key: str, size: int, n: int, properties: dict | None = None
) -> DataFrame:
    """One partition, and one range query pushed to the database, per id range.

    A failing range is retried by Spark and then fails the job; rows are
    never silently cut off after the first error.
    """
    return spark.read.jdbc(url, table, predicates=id_range_predicates(key, size, n), properties=properties or {})
