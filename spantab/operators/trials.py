"""Hyper-parameter trials and per-fold experiments."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantab.operators.metrics import in_bounds_column, match_column, r2_column, rmse_column
from spantab.functions.scalars import round_half_up
from spantab.operators.splits import SplitPlan

FOLD_SCHEMA = "fold int, set string, r2 double, accuracy double, rmse double, bounds_accuracy double"

_log = logging.getLogger(__name__)


def trial_grid(params: Mapping[str, Sequence], n_splits: int, experiments: DataFrame) -> DataFrame:
    """Every parameter combination and split for each row of ``experiments``.

    The grid is unfolded row by row from literal arrays: no join, no shuffle.
    """
    grid = experiments
    for name, values in params.items():
        literal = F.array(*(F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v) for v in values))
        grid = grid.withColumn(name, F.explode(literal))
    return grid.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))


def evaluate_folds(predicted: DataFrame) -> DataFrame:
    """(fold, set, r2, accuracy, rmse, bounds_accuracy) from columns y, p, lower, upper, fold, role."""
    y, p = F.col("y").cast("double"), F.col("p")
    rounded = round_half_up(p).cast("double")
    bounded = F.col("set") == "bounded"
    table = predicted.groupBy("fold", F.col("role").alias("set")).agg(
        r2_column(y, rounded).alias("r2"), match_column(y, p).alias("accuracy"),
        rmse_column(y, rounded).alias("rmse"), in_bounds_column("p", "lower", "upper").alias("bounds_accuracy"),
    )
    return table.select(
        "fold", "set",
        *(F.when(~bounded, F.col(c)).alias(c) for c in ("r2", "accuracy", "rmse")),
        F.when(bounded, F.col("bounds_accuracy")).alias("bounds_accuracy"),
    )


def evaluate_roles(predicted: DataFrame, fold: int) -> DataFrame:
    """:func:`evaluate_folds` of one fold."""
    return evaluate_folds(predicted.withColumn("fold", F.lit(fold)))


def fold_experiment(
    exact: DataFrame, bounded: DataFrame, plan: SplitPlan,
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
) -> DataFrame:
    """Fit on each fold's train rows; evaluate train, valid, test and bounded rows.

    ``fit`` gets the train rows and returns a function adding a column ``p``.
    A fold whose fit fails is logged and gives one row of set ``failed`` without
    measures, so that averages over fewer folds are seen. Each fold adds a
    handful of metric rows, so the result is a union of small aggregates.
    """
    exact = exact.persist()
    bounded = bounded.persist()
    rows, failures = [], 0
    try:
        for fold in range(len(plan.folds)):
            try:
                roles = plan.with_role(exact, fold).filter("role is not null")
                predict = fit(roles.filter("role = 'train'"))
                both = roles.unionByName(bounded.withColumn("role", F.lit("bounded")), allowMissingColumns=True)
                rows += evaluate_roles(predict(both), fold).collect()  # at most four rows
            except Exception as error:  # noqa: BLE001 - a failing fold must not end the others
                _log.warning("fold %d failed: %s", fold, error)
                rows.append((fold, "failed", None, None, None, None))
                failures += 1
    finally:
        exact.unpersist()
        bounded.unpersist()
    if failures == len(plan.folds):
        raise RuntimeError("every fold failed")
    return exact.sparkSession.createDataFrame(rows, FOLD_SCHEMA)
