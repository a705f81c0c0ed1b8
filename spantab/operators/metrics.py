"""Evaluation aggregates: one grouped, map-side combined pass per table of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.functions.scalars import _as_column, round_half_up, to_double


def _share(test: Column, percent: bool = False) -> Column:
    """Share of rows passing the test; a row whose test is unknown does not pass."""
    share = F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    return share * 100.0 if percent else share


def _unpredicted(y: Column, p: Column) -> Column:
    """Whether some row of the group has a target but no prediction: errors over the others would flatter the model."""
    p = p.cast("double")
    return F.count_if(y.isNotNull() & (p.isNull() | F.isnan(p))) > 0


def r2_column(y: Column, p: Column) -> Column:
    """1 - SSE / SST; a flat target gives 1 when predicted exactly, else 0. Missing predictions give 0."""
    error = F.sum(F.pow(y - p, F.lit(2)))
    spread = F.var_pop(y) * F.count(y)
    flat = F.when(error == 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    known = F.when(spread == 0.0, flat).otherwise(F.lit(1.0) - F.try_divide(error, spread))
    return F.when(_unpredicted(y, p), F.lit(0.0)).otherwise(known)


def rmse_column(y: Column, p: Column) -> Column:
    """Root of the mean squared error; infinite if a row with a target has no prediction."""
    return F.when(_unpredicted(y, p), F.lit(float("inf"))).otherwise(F.sqrt(F.avg(F.pow(y - p, F.lit(2)))))


def match_column(y: Column, p: Column, percent: bool = False) -> Column:
    return _share(round_half_up(p) == y, percent)


def in_bounds_column(
    p: Column | str, lower: Column | str, upper: Column | str, rounded: bool = True, percent: bool = False
) -> Column:
    """Share of predictions inside [lower, upper], ends included."""
    value = round_half_up(p) if rounded else F.nanvl(_as_column(p).cast("double"), F.lit(None).cast("double"))
    return _share(value.between(_as_column(lower), _as_column(upper)), percent)


def metrics(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    by: Sequence[str] = (),
    rounded: bool = True,
    percent: bool = False,
) -> DataFrame:
    """``r2, accuracy, rmse`` per group.

    ``rounded`` puts r2 and rmse on the rounded prediction, otherwise on the
    raw one; text predictions are read as numbers, bad text as 0.
    """
    truth = F.col(y).cast("double")
    kind = dict(df.dtypes)[p]
    guess = F.coalesce(to_double(p), F.lit(0.0)) if kind == "string" else F.col(p).cast("double")
    used = round_half_up(guess).cast("double") if rounded else guess
    return df.groupBy(*by).agg(
        r2_column(truth, used).alias("r2"),
        match_column(truth, guess, percent).alias("accuracy"),
        rmse_column(truth, used).alias("rmse"),
    )


def in_bounds(
    df: DataFrame, p: str = "p", lower: str = "lower", upper: str = "upper",
    by: Sequence[str] = (), percent: bool = False,
) -> DataFrame:
    return df.groupBy(*by).agg(in_bounds_column(p, lower, upper, percent=percent).alias("bounds_accuracy"))


def in_range_raw(
    df: DataFrame, p: str = "p", lower: str = "lower", upper: str = "upper", by: Sequence[str] = ()
) -> DataFrame:
    """Percentage of unrounded predictions in the interval, 0 for no rows."""
    inside = in_bounds_column(p, lower, upper, rounded=False, percent=True)
    return df.groupBy(*by).agg(F.coalesce(inside, F.lit(0.0)).alias("percent_in_range"))


def exact_match(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(match_column(F.col(y), F.col(p)).alias("accuracy"))


def interval_loss(
    df: DataFrame, p: str = "p", lower: str = "lower", upper: str = "upper", by: Sequence[str] = ()
) -> DataFrame:
    """Mean squared distance to the interval."""
    below = F.greatest(F.col(lower) - F.col(p), F.lit(0.0))
    above = F.greatest(F.col(p) - F.col(upper), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(below * below + above * above).alias("interval_loss"))


def fold_average(
    fold_metrics: DataFrame,
    by: Sequence[str] = ("set",),
    measures: Sequence[str] = ("r2", "accuracy", "rmse", "bounds_accuracy"),
) -> DataFrame:
    """Plain mean over folds of each measure present."""
    present = [m for m in measures if m in fold_metrics.columns]
    return fold_metrics.groupBy(*by).agg(*(F.avg(m).alias(m) for m in present))


def evaluate_sets(
    df: DataFrame, p: str = "p", y: str = "y", lower: str = "lower", upper: str = "upper",
    role: str = "role", sets: Sequence[str] = ("train", "valid", "test"), bounded: str = "bounded",
    model: str = "boosting",
) -> DataFrame:
    """(dataset, model, r2, accuracy, rmse, bounds_accuracy) per set, raw r2 and rmse, percent.

    Point-target sets get r2, accuracy and rmse; the bounded set gets the
    in-bounds share. Both come out of the same aggregation.
    """
    truth, guess = F.col(y).cast("double"), F.col(p).cast("double")
    point = df.filter(F.col(role).isin([*sets, bounded]))
    out = point.groupBy(F.col(role).alias("dataset")).agg(
        r2_column(truth, guess).alias("r2"),
        match_column(truth, guess, percent=True).alias("accuracy"),
        rmse_column(truth, guess).alias("rmse"),
        in_bounds_column(guess, lower, upper, percent=True).alias("bounds_accuracy"),
    )
    on_bounded = F.col("dataset") == bounded
    return out.select(
        "dataset",
        F.lit(model).alias("model"),
        *(F.when(~on_bounded, F.col(c)).alias(c) for c in ("r2", "accuracy", "rmse")),
        F.when(on_bounded, F.col("bounds_accuracy")).alias("bounds_accuracy"),
    )


def truth_table(df: DataFrame, p: str = "p", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Counts per true value and rounded prediction, with a correct flag."""
    guess = round_half_up(p)
    return df.groupBy(
        *by,
        F.col(y).cast("bigint").alias("truth"),
        guess.alias("predicted"),
        F.coalesce(guess == F.col(y), F.lit(False)).alias("correct"),
    ).agg(F.count(F.lit(1)).alias("n"))
