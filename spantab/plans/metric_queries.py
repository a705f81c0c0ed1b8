"""Queries over the evaluation aggregates, on predictions of the fixed model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.functions.scalars import round_half_up
from spantab.operators import metrics as M
from spantab.plans.proxy import PREDICTIONS_SQL, predictions
from spantab.plans.registry import big, query, r6, settle

_P = f"WITH p AS ({PREDICTIONS_SQL}), q AS (SELECT *, floor(p + 0.5::double) AS g FROM p) "
_FLAT = "CASE WHEN sum((y - {p}) * (y - {p})) = 0 THEN 1 ELSE 0 END"


def _r2(p: str) -> str:
    sse = f"sum((y - {p}) * (y - {p}))"
    return f"CASE WHEN var_pop(y) = 0 THEN {_FLAT.format(p=p)} ELSE 1 - {sse} / (var_pop(y) * count(y)) END"


def _metrics_sql(p: str, scale: str = "1") -> str:
    return (
        f"{r6(_r2(p))} AS r2, {r6(f'avg((g = y)::int) * {scale}')} AS accuracy,"
        f" {r6(f'sqrt(avg((y - {p}) * (y - {p})))')} AS rmse"
    )


@query(
    "f1_round_half_up",
    f"SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, {big('floor(l_extendedprice / 1000 + 0.5)')} AS up,"
    f" {big('floor(-l_quantity / 2 + 0.5::double)')} AS negative FROM lineitem",
)
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return settle(
        rows.select(
            "l_orderkey", "l_linenumber",
            round_half_up(F.col("l_extendedprice") / 1000).alias("up"),
            round_half_up(-F.col("l_quantity") / 2).alias("negative"),
        )
    )


@query(
    "f2_metrics",
    _P + f"SELECT fold::bigint AS fold, role, {_metrics_sql('g')} FROM q WHERE is_exact GROUP BY fold, role",
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.metrics(predictions(spark, sf_dir).filter("is_exact"), by=["fold", "role"]))


# Some folds lack predictions; no finite error may come out of what is left.
_GONE = "(fold = 1 AND level % 7 = 0) OR (fold = 2 AND level % 11 = 0)"


@query(
    "f2_missing_predictions",
    _P + f", m AS (SELECT *, {_GONE} AS gone FROM q WHERE is_exact) SELECT fold::bigint AS fold,"
    f" {r6(f'CASE WHEN bool_or(gone) THEN 0 ELSE {_r2('g')} END')} AS r2, {r6('avg((g = y AND NOT gone)::int)')} AS accuracy,"
    f" {r6(f'CASE WHEN bool_or(gone) THEN {chr(39)}inf{chr(39)}::double ELSE sqrt(avg((y - g) * (y - g))) END')} AS rmse"
    " FROM m GROUP BY fold",
)
def f2_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("is_exact")
    lost = F.when(F.col("fold") == 2, F.lit(float("nan")))
    rows = rows.withColumn("p", F.when(F.expr(_GONE), lost).otherwise(F.col("p")))
    return settle(M.metrics(rows, by=["fold"]))


@query(
    "f2_metrics_raw_percent",
    _P + f"SELECT role, {_metrics_sql('p', '100')} FROM q WHERE is_exact GROUP BY role",
)
def f2_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("is_exact")
    return settle(M.metrics(rows, by=["role"], rounded=False, percent=True))


@query(
    "f3_in_bounds",
    _P + f"SELECT role, {r6('avg((g BETWEEN lower AND upper)::int)')} AS bounds_accuracy FROM q GROUP BY role",
)
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.in_bounds(predictions(spark, sf_dir), by=["role"]))


@query(
    "f4_in_range_raw",
    _P + f"SELECT role, {r6('coalesce(avg((p BETWEEN lower AND upper)::int) * 100, 0)')} AS percent_in_range"
    " FROM q GROUP BY role",
)
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.in_range_raw(predictions(spark, sf_dir), by=["role"]))


@query(
    "f5_exact_match",
    _P + f"SELECT fold::bigint AS fold, {r6('avg((g = y)::int)')} AS accuracy FROM q WHERE is_exact GROUP BY fold",
)
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.exact_match(predictions(spark, sf_dir).filter("is_exact"), by=["fold"]))


_LOSS = "avg(greatest(lower - p, 0) * greatest(lower - p, 0) + greatest(p - upper, 0) * greatest(p - upper, 0))"


@query("f6_interval_loss", _P + f"SELECT role, {r6(_LOSS)} AS interval_loss FROM q GROUP BY role")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.interval_loss(predictions(spark, sf_dir), by=["role"]))


@query(
    "f7_fold_average",
    _P + f", m AS (SELECT fold, role AS set, {_r2('g')} AS r2, avg((g = y)::int) AS accuracy,"
    " sqrt(avg((y - g) * (y - g))) AS rmse FROM q WHERE is_exact GROUP BY fold, role)"
    f" SELECT set, {r6('avg(r2)')} AS r2, {r6('avg(accuracy)')} AS accuracy, {r6('avg(rmse)')} AS rmse"
    " FROM m GROUP BY set",
)
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("is_exact").withColumn("set", F.col("role"))
    return settle(M.fold_average(M.metrics(rows, by=["fold", "set"])))


@query(
    "f8_evaluate_sets",
    _P + f"SELECT role AS dataset, 'boosting' AS model, {_metrics_sql('p', '100')}, NULL::double AS bounds_accuracy"
    " FROM q WHERE role <> 'bounded' GROUP BY role UNION ALL SELECT 'bounded', 'boosting', NULL, NULL, NULL,"
    f" {r6('avg((g BETWEEN lower AND upper)::int) * 100')} FROM q WHERE role = 'bounded'",
)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.evaluate_sets(predictions(spark, sf_dir)))


@query(
    "f9_truth_table",
    _P + f"SELECT {big('y')} AS truth, {big('g')} AS predicted, g = y AS correct, count(*)::bigint AS n"
    " FROM q WHERE is_exact GROUP BY 1, 2, 3",
)
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(M.truth_table(predictions(spark, sf_dir).filter("is_exact")))
