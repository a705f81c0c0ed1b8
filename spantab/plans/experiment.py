"""The whole path as one plan: clean rows, deduplicate, split, fit, predict, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators.cleaning import expand_list, split_exact_bounded
from spantab.operators.folds import linear_folds
from spantab.operators.splits import dedup_first, fit_splits
from spantab.plans.proxy import NUMERICAL, typed
from spantab.staging import stage

def linear_experiment(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """(fold, set, r2, accuracy, rmse, bounds_accuracy) of a linear fit on all numerical columns per fold.

    The deduplicated rows are written once; splits, fits and evaluation read
    that table, and roles are computed row by row instead of joined.
    """
    rows = expand_list(typed(spark, sf_dir), "canonical_conjugator")
    lists = [f"canonical_conjugator_{i}" for i in range(4)]
    key = ["lower", "upper", *NUMERICAL, *lists]
    unique = stage(dedup_first(rows.select("id", *key, "q_gonality_bounds"), key, "id"), "unique")
    exact_rows, bounded = split_exact_bounded(unique)
    exact_rows = exact_rows.withColumn("y", F.col("lower"))
    plan = fit_splits(exact_rows, "id", n=folds)

    needed = ["id", *NUMERICAL, "lower", "upper"]
    return linear_folds(exact_rows.select(*needed, "y"), bounded.select(*needed), plan, NUMERICAL)
