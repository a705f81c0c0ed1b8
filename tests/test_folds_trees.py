"""One-pass folds, histogram trees and stacked quantiles beside plain computations."""

from __future__ import annotations

import hashlib
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantab.operators import folds as FO
from spantab.operators import linear as L
from spantab.operators.boosted_trees import TreeSettings, fit_trees, predict_trees, tree_folds
from spantab.operators.quantiles import exact_medians, exact_ranks
from spantab.operators.splits import fit_splits
from spantab.operators.trials import fold_experiment
from spantab.staging import staging_path


def jobs(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [
        (
            rng.gauss(0, 1), rng.choice([1.0, 2.0, 2.0, 7.5]), rng.paretovariate(0.3), 4.0, None,
            rng.choice([None, float("nan"), float("inf"), 3.0, -1e300, 1e300, 1e-300, -0.0]),
        )
        for _ in range(3001)
    ]
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)


def test_ranks_equal_sorting(numbers):
    rows, df = numbers
    got = exact_ranks(df, {c: F.col(c) for c in df.columns}, lambda n: [0, n // 7, n // 2, n - 1])
    for k, c in enumerate(df.columns):
        values = sorted(r[k] for r in rows if r[k] is not None and np.isfinite(r[k]))
        n = len(values)
        assert got[c] == ((n, [values[i] for i in (0, n // 7, n // 2, n - 1)]) if n else (0, []))


def test_medians_equal_numpy(numbers):
    rows, df = numbers
    got = exact_medians(df, {c: F.col(c) for c in "abcd"})
    assert [got[c] for c in "abcd"] == [float(np.median([r[k] for r in rows])) for k in range(4)]
    assert exact_medians(df, {"e": F.col("e")}) == {"e": 0.0} and exact_medians(df, {}) == {}


def test_passes_do_not_grow_with_columns(spark, numbers):
    _, df = numbers
    few = jobs(spark, lambda: exact_medians(df, {"a": F.col("a")}))
    many = jobs(spark, lambda: exact_medians(df, {i: F.col("a") + F.lit(float(i)) for i in range(20)}))
    assert many == few


@pytest.fixture(scope="module")
def fold_rows(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [3, 1000, 0]
    y = np.floor(x @ [2, 0.01, 30] + rng.normal(size=n) * 0.3)
    rows = [(f"k{i}", *map(float, x[i]), float(y[i]), float(y[i])) for i in range(n)]
    exact = spark.createDataFrame(rows, "id string, a double, b double, c double, lower double, y double")
    exact = exact.withColumn("upper", F.col("lower"))
    bounded = exact.limit(50).withColumn("upper", F.col("lower") + 2).drop("y")
    return exact.cache(), bounded.cache()


def as_dict(df):
    return {(r["fold"], r["set"]): tuple(r)[2:] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert all(x is y is None or abs(x - y) < 1e-9 for x, y in zip(a[k], b[k])), (k, a[k], b[k])


def test_folds_together_equal_folds_alone(fold_rows, monkeypatch):
    exact, bounded = fold_rows
    plan = fit_splits(exact, "id", n=3)

    def fit(train):
        model = L.ols_fit(train, ["a", "b", "c"], "y")
        return lambda rows: L.ols_predict(rows, model)

    together = as_dict(FO.linear_folds(exact, bounded, plan, ["a", "b", "c"]))
    close(together, as_dict(fold_experiment(exact, bounded, plan, fit)))
    monkeypatch.setattr(FO, "SQL_SUM_COLUMNS", 0)  # the path of wide designs
    close(together, as_dict(FO.linear_folds(exact, bounded, plan, ["a", "b", "c"])))


def test_jobs_do_not_grow_with_folds(spark, fold_rows):
    exact, bounded = fold_rows
    plans = {n: fit_splits(exact, "id", n=n) for n in (2, 20)}
    counts = {n: jobs(spark, lambda: FO.linear_folds(exact, bounded, plans[n], ["a", "b"])) for n in plans}
    assert counts[2] == counts[20]


def test_odd_fold_rows(spark):
    rows = [("a", 1.0, 1.0, 1.0, 1.0), (None, 5.0, 1.0, 1.0, 9.0), ("c", None, 2.0, 2.0, None), ("d", float("nan"), 3.0, 3.0, 3.0)]
    exact = spark.createDataFrame(rows, "id string, x double, lower double, upper double, y double")
    plan = fit_splits(exact, "id", n=1, frac=0.0, test_frac=0.0)
    found = as_dict(FO.linear_folds(exact, exact.drop("y"), plan, ["x"]))
    assert set(found) == {(0, "train"), (0, "bounded")}
    assert found[0, "train"][1] == pytest.approx(2 / 3)  # row c has no target, the row without a key no set


# Trees


def boost_by_hand(x, y, keys, settings, names):
    """Boosted trees of one fold in plain Python; the returned function predicts."""
    n = len(y)
    cuts = []
    for column in x.T:
        ordered = sorted(column)
        values = {ordered[k * n // settings.bins] for k in range(settings.bins)} - {ordered[0]}
        cuts.append(sorted(values))
    binned = np.array([[sum(c <= v for c in cuts[j]) for j, v in enumerate(row)] for row in x])
    p = np.full(n, y.mean())
    for t in range(settings.trees):
        limit, seed = settings.row_limit(), settings.row_seed(t)
        sampled = [i for i in range(n) if settings.row_share >= 1
                   or hashlib.md5(f"{seed}:{keys[i]}".encode()).hexdigest()[:8] < limit]
        g = p - y

        def value(rows):
            return -g[rows].sum() / (len(rows) + settings.penalty) if len(rows) else 0.0

        def score(rows):
            return g[rows].sum() ** 2 / (len(rows) + settings.penalty)

        def grow(fit_rows, all_rows, depth):
            out = {i: value(fit_rows) for i in all_rows}
            if depth == 0 or not fit_rows:
                return out
            best = (settings.min_gain, None)
            for j in settings.columns(names, t):
                for cut in range(1, len(cuts[j]) + 1):
                    left = [i for i in fit_rows if binned[i, j] < cut]
                    right = [i for i in fit_rows if binned[i, j] >= cut]
                    if len(left) >= settings.min_curvature and len(right) >= settings.min_curvature:
                        gain = round((score(left) + score(right) - score(fit_rows)) / 2, 6)
                        if gain > best[0]:
                            best = (gain, (j, cut))
            if best[1] is None:
                return out
            j, cut = best[1]
            for side in (lambda i: binned[i, j] < cut, lambda i: binned[i, j] >= cut):
                out.update(grow([i for i in fit_rows if side(i)], [i for i in all_rows if side(i)], depth - 1))
            return out

        leaves = grow(sampled, range(n), settings.depth)
        p = p + settings.rate * np.array([leaves[i] for i in range(n)])
    return p


@pytest.mark.parametrize("settings", [
    TreeSettings(trees=12, depth=3, rate=0.3, bins=8), TreeSettings(trees=2, depth=2, rate=1.0, bins=300, row_share=1.0, min_curvature=20),
    TreeSettings(trees=1, depth=2, min_gain=1e12),
])
def test_trees_equal_plain_python(spark, settings):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=150), rng.integers(0, 4, 150), rng.normal(size=150) ** 3])
    y = np.round(np.where(x[:, 0] > 0, 5, 0) * x[:, 1] + x[:, 2])
    keys = [f"r{i}" for i in range(150)]
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, r, t in zip(keys, x, y)],
                               "key string, a double, b double, c double, y double").repartition(4)
    names = ["a", "b", "c"]
    model = fit_trees(df, names, "y", "key", F.array(F.lit(0)), 1, settings)
    got = {r["key"]: r["p"][0] for r in predict_trees(df, model).collect()}
    want = boost_by_hand(x, y, keys, settings, names)
    assert [got[k] for k in keys] == pytest.approx(list(want), abs=1e-9)


def test_tree_jobs_do_not_grow_with_folds(spark, fold_rows):
    exact, bounded = fold_rows
    settings = TreeSettings(trees=2, depth=2, rate=0.5, bins=8)
    plans = {n: fit_splits(exact, "id", n=n) for n in (1, 6)}
    counts = {n: jobs(spark, lambda: tree_folds(exact, bounded, plans[n], ["a", "b"], settings)) for n in plans}
    assert abs(counts[1] - counts[6]) <= 2  # adaptive plans may split a job
    found = as_dict(tree_folds(exact, bounded, plans[6], ["a", "b"], settings))
    assert {s for _, s in found} == {"train", "valid", "test", "bounded"} and found[5, "train"][0] > 0.2


def test_trees_without_rows(spark):
    empty = spark.createDataFrame([], "key string, a double, y double")
    model = fit_trees(empty, ["a"], "y", "key", F.array(F.lit(0)), 1, TreeSettings(trees=1, depth=1))
    assert model.fitted == (False,)


def test_trees_read_their_rows_once(spark):
    """Counting, sampling and binning share one evaluation of the rows."""
    from spantab.operators.trees import gbt_fit

    seen = spark.sparkContext.accumulator(0)

    def noted(x: float) -> float:
        seen.add(1)
        return x

    rows = spark.range(40).select(F.udf(noted, "double")(F.col("id").cast("double")).alias("a"), F.col("id").alias("y"))
    gbt_fit(rows, ["a"], "y", maxDepth=1, maxIter=2)
    assert seen.value == 40


def test_rows_of_all_folds_are_files_and_leave_none(spark, fold_rows, monkeypatch):
    exact, bounded = fold_rows
    plan, cached, seen = fit_splits(exact, "id", n=3), spark.sparkContext._jsc.getPersistentRDDs, []
    exact.count(), bounded.count()
    before, evaluate = len(cached()), FO.evaluate_folds
    monkeypatch.setattr(FO, "evaluate_folds", lambda rows: (seen.append(len(cached())), evaluate(rows))[1])
    found = FO.linear_folds(exact, bounded, plan, ["a", "b", "c"]).collect()
    assert len(found) == 12 and seen == [before]
    names = os.listdir(os.path.dirname(staging_path(spark, "any").removeprefix("file:")))
    assert not [n for n in names if n.startswith("fold-rows-")]
