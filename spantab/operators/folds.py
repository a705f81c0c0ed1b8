"""All folds of a repeated linear experiment together.

Rows are placed in their folds by expression. One aggregate gives rough moments
of all rows, a second, keyed by fold, sums of products of the columns so
standardised; a third evaluates the predictions of all folds grouped by
(fold, role). The number of jobs does not depend on the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.functions.scalars import clean_double
from spantab.operators.cleaning import _quoted
from spantab.operators.linear import SQL_SUM_COLUMNS, Moments, _finish, _products, partial_sums, solve, weighted_sum
from spantab.operators.splits import SplitPlan
from spantab.operators.trials import FOLD_SCHEMA, evaluate_folds
from spantab.staging import staged


@dataclass(frozen=True)
class FoldModels:
    """One linear model per fold; a fold without train rows is not fitted."""

    names: tuple[str, ...]
    coef: np.ndarray
    intercept: np.ndarray
    fitted: tuple[bool, ...]


def fold_moments(df: DataFrame, columns: Sequence[Column], folds: Column, n_folds: int) -> list[Moments]:
    """Moments of the columns per fold, over the rows whose array ``folds`` names it.

    Every column must be finite. All columns are first standardised by the
    moments of all rows, so sums of products keep their digits.
    """
    width = len(columns)
    named = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)), folds.alias("folds"))
    terms = [F.col(f"c{i}") for i in range(width)]
    (row,) = named.agg(
        *(F.avg(t).alias(f"m{i}") for i, t in enumerate(terms)), *(F.stddev_pop(t).alias(f"s{i}") for i, t in enumerate(terms))
    ).collect()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    spread = np.array([row[f"s{i}"] or 0.0 for i in range(width)])
    scale = np.where(spread > 1e-9 * np.maximum(np.abs(mean), 1e-300), spread, 1.0)
    standard = [(t - F.lit(float(m))) / F.lit(float(s)) for t, m, s in zip(terms, mean, scale)]
    if width <= SQL_SUM_COLUMNS:
        sums = _sums_by_fold(named.select(*(t.alias(f"c{i}") for i, t in enumerate(standard)), "folds"), width, n_folds)
    else:
        members = [F.array_contains("folds", f).cast("double") for f in range(n_folds)]

        def by_fold(raw: np.ndarray) -> np.ndarray:
            x, inside = raw[:, :width], raw[:, width:] > 0
            return np.concatenate([_products(x[inside[:, f]]).ravel() for f in range(n_folds)])

        sums = partial_sums(named, [*standard, *members], by_fold, n_folds * (width + 1) ** 2)
        sums = sums.reshape(n_folds, width + 1, width + 1)
    return [_finish(mean, scale, sums[f]) for f in range(n_folds)]


def _sums_by_fold(named: DataFrame, width: int, n_folds: int) -> np.ndarray:
    terms = [F.lit(1.0), *(F.col(f"c{i}") for i in range(width))]
    cells = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    rows = named.select(*(f"c{i}" for i in range(width)), F.explode("folds").alias("fold")).groupBy("fold").agg(
        *(F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in cells)
    )
    out = np.zeros((n_folds, width + 1, width + 1))
    for row in rows.collect():  # one per fold
        for i, j in cells:
            out[row["fold"], i, j] = out[row["fold"], j, i] = row[f"s{i}_{j}"]
    return out


def fit_folds(df: DataFrame, features: Sequence[str], target: str, folds: Column, n_folds: int) -> FoldModels:
    """Least squares per fold, over the rows with a target whose array ``folds`` names the fold.

    A missing or non-finite feature counts as 0, as it does in predictions.
    """
    y = _quoted(target).cast("double")
    known = df.filter(y.isNotNull() & ~F.isnan(y))
    columns = [*(clean_double(_quoted(c)) for c in features), y]
    p = len(features)
    moments = fold_moments(known, columns, folds, n_folds)
    solved = [solve(m, range(p), p) for m in moments]
    return FoldModels(
        tuple(features), np.array([c for c, _ in solved]).reshape(n_folds, p), np.array([i for _, i in solved]),
        tuple(m.n > 0 for m in moments),
    )


def predict_folds(df: DataFrame, models: FoldModels, name: str = "p") -> DataFrame:
    """Add the array of all folds' predictions; a non-finite one is 0."""
    cleaned = [clean_double(_quoted(c)) for c in models.names]
    every = [clean_double(weighted_sum(cleaned, c, i)) for c, i in zip(models.coef, models.intercept)]
    return df.withColumn(name, F.array(*every))


def linear_folds(
    exact: DataFrame, bounded: DataFrame, plan: SplitPlan, features: Sequence[str], target: str = "y"
) -> DataFrame:
    """(fold, set, r2, accuracy, rmse, bounds_accuracy) of a linear fit on the train rows of each fold.

    Train, valid and test rows come from ``exact`` by the plan; bounded rows are
    evaluated in every fold. Rows of ``exact`` without a key belong to no set. A
    fold without train rows gives one row of set ``failed``.
    """
    n = len(plan.folds)
    everywhere = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit("bounded").alias("role")) for f in range(n)))
    inputs = [*(clean_double(_quoted(c)).alias(f"x{i}") for i, c in enumerate(features)), "lower", "upper"]
    y = _quoted(target).cast("double").alias("y")
    placed = exact.filter(_quoted(plan.key).isNotNull()).select(*inputs, y, plan.placements().alias("placed"))
    rows = placed.unionByName(
        bounded.select(*inputs, F.lit(None).cast("double").alias("y"), everywhere.alias("placed"))
    )
    names = [f"x{i}" for i in range(len(features))]
    with staged(rows, "fold-rows") as data:
        train = F.transform(F.filter("placed", lambda s: s["role"] == "train"), lambda s: s["fold"])
        models = fit_folds(data, names, "y", train, n)
        predicted = predict_folds(data, models).select("y", "lower", "upper", "p", F.explode("placed").alias("s"))
        every = predicted.select("y", "lower", "upper", "s.fold", "s.role", F.get("p", F.col("s.fold")).alias("p"))
        working = every.filter(F.col("fold").isin([f for f in range(n) if models.fitted[f]]))
        found = [tuple(r) for r in evaluate_folds(working).collect()]  # at most four per fold
    if not any(models.fitted):
        raise RuntimeError("every fold failed")
    found += [(f, "failed", None, None, None, None) for f in range(n) if not models.fitted[f]]
    return exact.sparkSession.createDataFrame(found, FOLD_SCHEMA)
