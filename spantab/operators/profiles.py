"""Null profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.operators.cleaning import _is_missing, _quoted


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, token: str = "None") -> DataFrame:
    """(column, total, nulls, leftover, any_null) per column out of one aggregation.

    ``leftover`` counts text cells that still hold the literal null token.
    """
    names = list(columns or df.columns)
    counts = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(names):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        counts.append(F.count_if(_is_missing(df, c)).alias(f"n{i}"))
        counts.append((F.count_if(_quoted(c) == token) if is_text else F.count_if(F.lit(False))).alias(f"t{i}"))
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col("total"), F.col(f"n{i}").alias("nulls"),
                   F.col(f"t{i}").alias("leftover")) for i, c in enumerate(names))
    )
    rows = df.agg(*counts).select(F.explode(pairs).alias("p")).select("p.*")
    return rows.withColumn("any_null", F.col("nulls") > 0)
