from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantab.operators import boosting as B
from spantab.operators import linear as L
from spantab.operators import mlp as N
from spantab.operators.features import monomial_names


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    n = 800
    level, genus = rng.integers(1, 50, n).astype(float), rng.integers(0, 9, n).astype(float)
    cusps = rng.integers(1, 13, n).astype(float)
    y = np.floor(1 + 0.1 * level + np.log1p(cusps) + 0.3 * genus + rng.uniform(0, 1, n))
    return level, genus, cusps, y


@pytest.fixture(scope="module")
def frame(spark, numbers):
    rows = [tuple(map(float, r)) for r in zip(*numbers)]
    return spark.createDataFrame(rows, "level double, genus double, cusps double, y double").repartition(5).cache()


def direct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def test_ols_equals_direct_solution(frame, numbers):
    level, genus, cusps, y = numbers
    model = L.ols_fit(frame, ["level", "genus", "cusps"], "y")
    want = direct(np.column_stack([level, genus, cusps]), y)
    np.testing.assert_allclose([model.intercept, *model.coef], want, rtol=1e-9)
    residual = L.ols_predict(frame, model).select(
        *(F.abs(F.sum((F.col("y") - F.col("p")) * F.col(c))) for c in ("level", "genus", "cusps"))
    ).first()
    assert max(residual) < 1e-6


def test_rank_deficient_takes_least_norm(frame):
    df = frame.withColumns({"twice": F.col("level") * 2, "flat": F.lit(7.0)})
    model = L.ols_fit(df, ["level", "twice", "flat"], "y")
    rows = df.select("level", "twice", "flat", "y").toPandas()
    x = rows[["level", "twice", "flat"]].to_numpy()
    want = np.linalg.lstsq(x - x.mean(axis=0), rows["y"] - rows["y"].mean(), rcond=None)[0]
    np.testing.assert_allclose(model.coef, want, atol=1e-9)


def test_non_finite_feature_gives_the_mean(frame):
    df = frame.withColumn("bad", F.when(F.col("level") > 40, F.lit(float("nan"))).otherwise(F.col("level")))
    model = L.ols_fit(df, ["bad"], "y")
    assert model.coef.tolist() == [0.0]
    assert model.intercept == pytest.approx(df.agg(F.avg("y")).first()[0])


def test_predict_guards_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (None, 2.0), (1e308, 1e308)], "a double, b double")
    model = L.LinearModel(("a", "b"), np.array([10.0, 10.0]), 1.0)
    assert [r["p"] for r in L.ols_predict(df, model).collect()] == [31.0, 21.0, 21.0, 0.0]


def test_wide_and_narrow_sums_agree(frame, monkeypatch):
    columns = [F.col(c) for c in ("level", "genus", "cusps", "y")]
    narrow = L.product_sums(frame, columns)
    monkeypatch.setattr(L, "SQL_SUM_COLUMNS", 0)
    np.testing.assert_allclose(L.product_sums(frame, columns), narrow)


def test_cubic_base_equals_direct_predictions(frame, numbers):
    level, genus, cusps, y = numbers
    model = B.fit_initial(frame, ["level", "genus", "cusps"], "y", degree=3)
    x = L.Design(("level", "genus", "cusps"), 3).expand(np.column_stack([level, genus, cusps]))
    beta = direct(x, y)
    want = beta[0] + x @ beta[1:]
    np.testing.assert_allclose(model.predict_matrix(x), want, atol=1e-5)
    share = 100 * np.mean(np.floor(want + 0.5) == y)
    assert model.current_accuracy == pytest.approx(share, abs=0.2)
    names = [r["name"] for r in B.coefficients(model, frame.sparkSession).orderBy("position").collect()]
    assert names == [*("poly_" + n for n in monomial_names(["level", "genus", "cusps"], 3)), "poly_intercept"]


def test_score_equals_direct_and_prediction_after_adding(frame, numbers):
    level, genus, cusps, y = numbers
    model = B.fit_initial(frame, ["level", "genus"], "y", degree=1)
    batch = [(1, "logs", "log(row['cusps'])"), (2, "flat", "3"), (3, "spanned", "row['level'] - 2 * row['genus']"),
             (4, "ratio", "row['cusps'] / (row['genus'] + 1)"), (5, "broken", "[1]")]
    scores = {s["name"]: s for s in B.score_rows(frame, model, batch, "y")}
    assert set(scores) == {"logs", "ratio"}
    x = np.column_stack([level, genus])
    base = direct(x, y)
    r = y - base[0] - x @ base[1:]
    for name, z in (("logs", np.log(cusps)), ("ratio", cusps / (genus + 1))):
        g = direct(x, z)
        e = z - g[0] - x @ g[1:]
        slope = (e @ r) / (e @ e)
        s = scores[name]
        assert s["slope"] == pytest.approx(slope, rel=1e-8)
        np.testing.assert_allclose([s["predictor_intercept"], *s["predictor"]], g, rtol=1e-7, atol=1e-10)
        want = 100 * np.mean(np.floor(base[0] + x @ base[1:] + slope * e + 0.5) == y)
        assert s["accuracy"] == pytest.approx(want, abs=0.15)
        added = B.add_feature(model, s)
        assert B.accuracy(frame, added, "y") == pytest.approx(s["accuracy"], abs=0.15)
    once = B.add_feature(model, scores["logs"])
    (second,) = B.score_rows(frame, once, [(4, "ratio", "row['cusps'] / (row['genus'] + 1)")], "y")
    twice = B.add_feature(once, second)
    assert B.accuracy(frame, twice, "y") == pytest.approx(second["accuracy"], abs=0.15)


def test_wide_prediction_equals_expression(frame, monkeypatch):
    model = B.fit_initial(frame, ["level", "genus"], "y", degree=2)
    model = B.add_feature(model, B.score_rows(frame, model, [(1, "logs", "log(row['cusps'])")], "y")[0])
    narrow = B.boosted_predict(frame, model, "a")
    monkeypatch.setattr(B, "SQL_PREDICT_COLUMNS", 0)
    both = B.boosted_predict(narrow, model, "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_validation_rules(spark):
    def column(bad, value=float("nan"), n=100):
        return [value if i < bad else float(i) for i in range(n)]

    data = list(zip(column(0), column(5), column(6), column(1, 1e11), [4.0] * 100, column(5, None)))
    df = spark.createDataFrame(data, "clean double, edge double, bad double, huge double, flat double, nulls double")
    got = {r["column"]: r for r in B.validate_features(df, df.columns).collect()}
    assert {c for c, r in got.items() if r["accepted"]} == {"clean", "edge", "huge", "nulls"}
    assert got["clean"]["fill"] is None
    assert got["edge"]["fill"] == got["nulls"]["fill"] == np.median(range(5, 100))
    filled = [52.0] * 5 + list(range(5, 100))
    assert got["edge"]["variance"] == pytest.approx(np.var(filled, ddof=1))


def test_fill_reaches_the_model(spark):
    rows = [(float(i), 1e12 if i == 3 else float(i % 7), float(i % 7 + (i > 50))) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = B.fit_initial(df, ["a"], "y", degree=1)
    (score,) = B.score_rows(df, model, [(1, "b", "row['b']")], "y")
    assert score["fill"] is not None
    added = B.add_feature(model, score)
    assert B.accuracy(df, added, "y") == pytest.approx(score["accuracy"])
    assert B.boosted_predict(df, added).agg(F.max(F.abs("p"))).first()[0] < 1e3


def test_selection(spark):
    scores = spark.createDataFrame([(2, 50.0), (1, 50.0), (3, 40.0)], "seq long, accuracy double")
    assert B.select_candidate(scores, 49.0).first()["seq"] == 1
    assert B.select_candidate(scores, 49.995).count() == 0
    assert B.select_candidate(scores, 49.99).count() == 1


def candidates(spark, bodies):
    rows = [(i, f"def f{i}(row): return {b}", f"n{i}", b, "why") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "seq long, code_str string, name string, body string, reason string")


def test_boost_loop_and_state(frame, spark, tmp_path):
    bodies = ["row['level']", "row['genus']", "1", "2", "log(row['cusps'] + 1)", "row['cusps']", "row['level'] // 10",
              "sqrt(row['level'])", "row['genus'] // 2", "row['cusps'] // 3"]
    seen = []
    run = B.start_run(frame, ["level", "genus"], "y", degree=1)
    base = run.model.current_accuracy
    run = B.boost_loop(frame, candidates(spark, bodies), "y", run, rounds=6, on_round=lambda r: seen.append(r.iteration))
    assert seen == [1, 2, 3, 4, 5, 6]
    assert run.model.stages and run.model.stages[0].name == "n4"
    assert run.best_model.current_accuracy >= base + B.MIN_GAIN
    assert run.accuracies == sorted(run.accuracies)
    assert B.accuracy(frame, run.model, "y") == pytest.approx(run.model.current_accuracy, abs=0.15)
    path = str(tmp_path / "state")
    B.save_state(run, spark, path)
    loaded = B.load_state(spark, path)
    assert loaded.model == run.best_model and loaded.queue == run.queue and loaded.accuracies == run.accuracies
    a = B.boosted_predict(frame, run.model, "a")
    assert B.boosted_predict(a, loaded.model, "b").filter("a <> b").count() == 0
    resumed = B.boost_loop(frame, candidates(spark, bodies), "y", loaded, rounds=7)
    assert resumed.iteration == 7


def test_queue_cap():
    run = B.BoostRun(None, None, [], queue=[str(i) for i in range(20)])
    B._cap(run, 42)
    assert len(run.queue) == 15 and run.queue[-8:] == [str(i) for i in range(12, 20)]


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(20, 3)), rng.normal(size=(20, 2))
    t[:, 1] = t[:, 0] + 0.3
    for loss in (N.squared_loss, N.interval_squared_loss):
        net = N.new_network(3, (4, 3))

        def total(w, loss=loss, net=net):
            p, _ = N.Network(net.sizes, w, net.slope).forward(x)
            return loss(p[:, 0], t)[0].sum()

        p, trace = net.forward(x)
        delta = loss(p[:, 0], t)[1][:, None]
        got = net.backward(trace, delta)
        for k in range(0, len(net.weights), 5):
            step = np.zeros_like(net.weights)
            step[k] = 1e-6
            want = (total(net.weights + step) - total(net.weights - step)) / 2e-6
            assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("optimizer", ["Adam", "AdamW", "SGD"])
def test_training_lowers_the_loss(frame, optimizer):
    df = frame.selectExpr("(level - 25) / 14 AS level", "(genus - 4) / 2.6 AS genus", "y", "y + 1 AS z")
    fit = N.mlp_fit(df, ["level", "genus"], "y", (8,), 6, rate=0.02, optimizer=optimizer)
    assert fit.losses[-1] < fit.losses[0] and len(fit.losses) == 7
    loss = N.mlp_predict(df, fit.network, ["level", "genus"]).agg(F.avg(F.pow(F.col("y") - F.col("p"), 2))).first()[0]
    assert loss == pytest.approx(fit.losses[-1])
    weak = N.interval_fit(df, ["level", "genus"], "y", "z", epochs=3, rate=0.02, optimizer=optimizer, start=fit.network)
    assert weak.losses[-1] < weak.losses[0]


def test_linear_case_without_hidden_layers(frame):
    net = N.Network((1, 1), np.array([2.0, -1.0]), final_activation=False)
    assert N.mlp_predict(frame.limit(3), net, ["level"]).filter("abs(p - (2 * level - 1)) > 1e-12").count() == 0
    assert math.isfinite(N.interval_fit(frame, ["level"], "y", "y", (), 1, rate=1e-4).losses[-1])


def test_missing_cells_mean_the_same_at_any_width(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (4.0, 5.0)], "a double, b double")
    narrow = {(r.a, r.b): r.value for r in L.gram(df, ["a", "b"]).collect()}
    monkeypatch.setattr(L, "SQL_SUM_COLUMNS", 0)
    wide = {(r.a, r.b): r.value for r in L.gram(df, ["a", "b"]).collect()}
    assert repr(sorted(narrow.items())) == repr(sorted(wide.items()))
    assert narrow[("a", "a")] == 26.0 and math.isnan(narrow[("a", "b")])


def test_rows_without_a_target_are_not_fitted(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)] + [(9.0, None)], "x double, y double")
    model = L.ols_fit(df, ["x"], "y")
    assert model.coef[0] == pytest.approx(2.0) and model.intercept == pytest.approx(1.0)
    assert B.fit_initial(df, ["x"], "y", degree=1).current_accuracy == 100.0
