"""Triangular factors beside direct solves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantab.operators import boosting as B
from spantab.operators import linear as L
from spantab.operators.factors import factor_and_solve


def plain(raw):
    return raw


@pytest.fixture(scope="module")
def near(spark):
    """Three columns that almost coincide, far from zero."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=500) + 1000
    x = np.column_stack([a, a + 1e-5 * rng.normal(size=500), a * 1.5 + 1e-4 * rng.normal(size=500)])
    y = x @ [3.0, -2.0, 0.5] + 7 + 1e-6 * rng.normal(size=500)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(6)


def test_collinear_columns_keep_their_digits(near):
    x, y, df = near
    model = L.ols_fit(df, ["a", "b", "c"], "y")
    centred = x - x.mean(axis=0)
    direct = np.linalg.lstsq(centred, y - y.mean(), rcond=None)[0]
    np.testing.assert_allclose(model.coef, direct, rtol=1e-6)
    sums = np.column_stack([np.ones(500), x, y])
    sums = sums.T @ sums
    normal = np.linalg.lstsq(sums[:4, :4], sums[:4, 4], rcond=None)[0][1:]
    assert np.abs(normal - direct).max() > 1e4 * np.abs(model.coef - direct).max()  # what sums of products lose


def test_spanned_columns_take_the_least_norm(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("x2"), (F.col("id") * 5.0).alias("y"))
    np.testing.assert_allclose(L.ols_fit(df, ["x", "x2"], "y").coef, [1.0, 2.0], atol=1e-9)


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 5.0)][:rows], "a double, b double, y double")
    model = L.ols_fit(df, ["a", "b"], "y")
    for a, b, y in [(1.0, 2.0, 3.0), (2.0, 1.0, 5.0)][:rows]:
        assert model.coef @ [a, b] + model.intercept == pytest.approx(y)


def test_bordered_factor_equals_a_fresh_one(near):
    _, _, df = near
    columns = [F.col(c) for c in ("a", "c", "b", "y")]
    small, _, _ = factor_and_solve(df, [columns[0], columns[1], columns[3]], plain, 2)
    whole, _, _ = factor_and_solve(df, columns, plain, 3)
    x = np.array([[r["a"], r["c"], r["b"]] for r in df.collect()])
    s, z = small.standard(x[:, :2]), (x[:, 2] - whole.mean[2]) / whole.scale[2]
    grown = small.bordered(s.T @ z, float(z @ z), whole.mean[2], whole.scale[2])
    np.testing.assert_allclose(grown.r.T @ grown.r, whole.r.T @ whole.r, atol=1e-6)


def test_rounds_reuse_the_factor(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(1, 9, size=(400, 2))
    y = np.floor(2 * x[:, 0] + np.sin(x[:, 1]) * 3 + x[:, 1] ** 4 / 500)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "u double, v double, y double")
    bodies = ["row['u'] * 2", "math.sin(row['v'])", "row['v'] ** 4", "math.log(row['u'])", "row['u'] // 2", "math.cos(row['v'])",
              "math.exp(row['v'] / 9)", "row['v'] % 2"]
    candidates = spark.createDataFrame(
        [(i, f"c{i}", f"n{i}", b, "") for i, b in enumerate(bodies)],
        "seq bigint, code_str string, name string, body string, reason string",
    )
    start = B.start_run(df, ["u", "v"], "y", degree=1)
    made = []
    whole = B.design_factor
    monkeypatch.setattr(B, "design_factor", lambda *a: made.append(1) or whole(*a))
    run = B.boost_loop(df, candidates, "y", start, rounds=8)
    assert run.model.stages and not made  # no scan of the whole design after the first one
    fresh = whole(df, run.model, "y")
    np.testing.assert_allclose(run.factor.mean, fresh.mean, rtol=1e-9)
    left = run.factor.r.T @ run.factor.r
    np.testing.assert_allclose(left, fresh.r.T @ fresh.r, atol=1e-6 * 400)
    assert B.accuracy(df, run.model, "y") == pytest.approx(run.model.current_accuracy)


def test_invalid_cells_take_the_median(spark):
    rows = [(float(i), float(i % 7), float(i + 3 * (i % 7))) for i in range(200)]
    df = spark.createDataFrame(rows, "u double, v double, y double")
    model = B.fit_initial(df, ["u"], "y", degree=1)
    body = "row['v'] if row['u'] > 4 else 1e300"  # five cells beyond the limit
    (score,) = B.score_rows(df, model, [(1, "n", body)], "y")
    assert score["fill"] == float(np.median([r[1] for r in rows[5:]]))
    z = np.array([r[1] if r[0] > 4 else score["fill"] for r in rows])
    u, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    design = np.column_stack([np.ones(200), u])
    rest = z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
    assert score["slope"] == pytest.approx(rest @ y / (rest @ rest))
    after = B.add_feature(model, score)
    assert B.accuracy(df, after, "y") == pytest.approx(score["accuracy"])
