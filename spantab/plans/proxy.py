"""A table of the modelled shape with a learnable interval target, derived from ``lineitem``.

The expressions below are text that both engines read the same way, so the
DataFrame and the SQL twin can not drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators.cleaning import (
    coerce_numeric,
    derive_rank,
    expand_list,
    is_exact,
    parse_lists,
    split_exact_bounded,
)
from spantab.staging import spread

NUMERICAL = (
    "level", "genus", "rank", "cusps", "rational_cusps", "log_conductor", "coarse_class_num", "coarse_level",
)
CATEGORICAL = ("pointless", "contains_negative_one", "level_is_squarefree")
LISTS = ("canonical_conjugator", "conductor")

_BASE = {
    "id": "concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-',"
    " cast(l_partkey AS string), '-', cast(l_suppkey AS string))",
    "level": "cast(l_quantity AS int)",
    "genus": "cast(l_linenumber AS int)",
    "genus_minus_rank": "least(cast(l_linenumber AS int), cast(l_orderkey % 3 AS int))",
    "cusps": "cast(l_partkey % 13 AS int) + 1",
    "rational_cusps": "cast(l_suppkey % 5 AS int)",
    "log_conductor": "CASE WHEN l_orderkey % 50 = 0 THEN 'None'"
    " ELSE cast(round(ln(l_extendedprice), 4) AS string) END",
    "coarse_class_num": "cast(l_orderkey % 17 AS int)",
    "coarse_level": "cast(l_quantity AS int) % 10",
    "pointless": "l_returnflag = 'R'",
    "contains_negative_one": "l_linestatus = 'O'",
    "level_is_squarefree": "(cast(l_quantity AS int) % 4 <> 0 AND cast(l_quantity AS int) % 9 <> 0"
    " AND cast(l_quantity AS int) % 25 <> 0 AND cast(l_quantity AS int) % 49 <> 0)",
    "canonical_conjugator": "CASE WHEN l_partkey % 10 = 0"
    " THEN concat('[', cast(l_partkey % 7 AS string), ', ', cast(l_suppkey % 7 AS string), ']')"
    " ELSE concat('[', cast(l_partkey % 7 AS string), ', ', cast(l_suppkey % 7 AS string), ', ',"
    " cast(l_orderkey % 7 AS string), ', 1]') END",
    "conductor": "CASE WHEN l_orderkey % 11 = 0 THEN '[]'"
    " ELSE concat('[[2, ', cast(l_orderkey % 4 AS string), '], [3, ', cast(l_partkey % 4 AS string), ']]') END",
    "lo": "cast(1 + floor(l_linenumber * cast(0.5 AS double)) + floor(l_quantity * cast(0.1 AS double)) + l_partkey % 2 AS int)",
    "w": "CASE WHEN l_suppkey % 4 = 0 THEN cast(l_partkey % 4 AS int) ELSE 0 END",
}
_BOUNDS = "concat('[', cast(lo AS string), ', ', cast(lo + w AS string), ']')"
_PLAIN = [c for c in _BASE if c not in ("lo", "w")]

CURVES_SQL = (
    f"SELECT {', '.join(_PLAIN)}, {_BOUNDS} AS q_gonality_bounds FROM (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _BASE.items())
    + " FROM lineitem) b"
)
# The typed view: rank, numbers, lists as lists, bounds as two columns.
TYPED_SQL = f"""SELECT id, level, genus, genus_minus_rank, genus - genus_minus_rank AS rank, cusps, rational_cusps,
  try_cast(log_conductor AS double) AS log_conductor, coarse_class_num, coarse_level, pointless,
  contains_negative_one, level_is_squarefree, cast(canonical_conjugator AS int[]) AS canonical_conjugator,
  cast(conductor AS int[][]) AS conductor, cast(q_gonality_bounds AS int[]) AS q_gonality_bounds,
  cast(q_gonality_bounds AS int[])[1] AS lower, cast(q_gonality_bounds AS int[])[2] AS upper
FROM ({CURVES_SQL}) c"""
# A fixed linear model over the typed view, for the evaluation queries.
FIXED_COEF = {"genus": 0.5, "level": 0.1, "cusps": 0.01}
FIXED_INTERCEPT = 1.0
FIXED_P_SQL = "(" + " + ".join(f"{v}::double * {c}" for c, v in FIXED_COEF.items()) + f" + {FIXED_INTERCEPT}::double)"
PREDICTIONS_SQL = f"""SELECT id, level, pointless, lower, upper, lower AS y, {FIXED_P_SQL} AS p,
  lower = upper AS is_exact, cast(cusps % 5 AS int) AS fold,
  CASE WHEN lower <> upper THEN 'bounded' WHEN coarse_class_num % 10 = 0 THEN 'test'
       WHEN coarse_class_num % 10 = 1 THEN 'valid' ELSE 'train' END AS role
FROM ({TYPED_SQL}) t"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text view: lists and some numbers are still text."""
    base = spread(table(spark, sf_dir, "lineitem")).selectExpr(*(f"{e} AS {c}" for c, e in _BASE.items()))
    return base.selectExpr(*_PLAIN, f"{_BOUNDS} AS q_gonality_bounds")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view after rank, numeric coercion, list parsing and bounds columns."""
    return typed_rows(curves(spark, sf_dir))


def typed_rows(raw: DataFrame) -> DataFrame:
    """Rows of the text view, typed."""
    df = coerce_numeric(derive_rank(raw), ["log_conductor"])
    df = parse_lists(df, {"canonical_conjugator": 1, "conductor": 2, "q_gonality_bounds": 1})
    bounds = F.col("q_gonality_bounds")
    return df.withColumns({"lower": F.get(bounds, 0), "upper": F.get(bounds, 1)})


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rows with the scalar target ``y`` and the expanded list columns."""
    df = split_exact_bounded(typed(spark, sf_dir))[0].withColumn("y", F.col("lower"))
    return expand_list(df, "canonical_conjugator")


def fixed_prediction() -> Column:
    total = None
    for name, weight in FIXED_COEF.items():
        term = F.lit(weight) * F.col(name)
        total = term if total is None else total + term
    return total + F.lit(FIXED_INTERCEPT)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the fixed model with a fold and a role per row."""
    role = (
        F.when(F.col("lower") != F.col("upper"), "bounded")
        .when(F.col("coarse_class_num") % 10 == 0, "test")
        .when(F.col("coarse_class_num") % 10 == 1, "valid")
        .otherwise("train")
    )
    return typed(spark, sf_dir).select(
        "id", "level", "pointless", "lower", "upper", F.col("lower").alias("y"),
        fixed_prediction().alias("p"),
        is_exact().alias("is_exact"),
        (F.col("cusps") % 5).cast("int").alias("fold"),
        role.alias("role"),
    )
