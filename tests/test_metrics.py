from __future__ import annotations

import pytest

from spantab.operators import metrics as M


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", 3, 2.6, 2, 4), ("a", 1, 1.5, 1, 1), ("a", 2, 2.4, 0, 3), ("b", 5, 5.0, 5, 5), ("b", 5, 4.6, 6, 7)]
    return spark.createDataFrame(data, "g string, y int, p double, lower int, upper int")


def by(df, key="g"):
    return {r[key]: r for r in df.collect()}


def test_rounded_and_raw(rows):
    got = by(M.metrics(rows, by=["g"]))
    assert got["a"]["accuracy"] == pytest.approx(2 / 3)
    assert got["a"]["r2"] == pytest.approx(1 - 1 / 2)
    assert got["a"]["rmse"] == pytest.approx((1 / 3) ** 0.5)
    assert got["b"]["r2"] == 1.0  # flat target, no error
    raw = by(M.metrics(rows, by=["g"], rounded=False, percent=True))
    assert raw["a"]["accuracy"] == pytest.approx(200 / 3)
    assert raw["b"]["r2"] == 0.0  # flat target, some error


def test_bounds(rows):
    assert by(M.in_bounds(rows, by=["g"]))["b"]["bounds_accuracy"] == 0.5
    assert by(M.in_range_raw(rows, by=["g"]))["a"]["percent_in_range"] == pytest.approx(200 / 3)
    assert M.in_range_raw(rows.limit(0)).first()[0] == 0.0
    assert by(M.interval_loss(rows, by=["g"]))["b"]["interval_loss"] == pytest.approx(1.4**2 / 2)


def test_missing_predictions_do_not_match(spark):
    df = spark.createDataFrame([(1, float("nan"), 0, 2), (1, None, 0, 2), (1, 1.0, 0, 2)], "y int, p double, lower int, upper int")
    assert M.exact_match(df).first()[0] == pytest.approx(1 / 3)
    assert M.in_bounds(df).first()[0] == pytest.approx(1 / 3)
    assert M.in_range_raw(df).first()[0] == pytest.approx(100 / 3)


def test_text_predictions(spark):
    df = spark.createDataFrame([(0, "x"), (2, "2.2")], "y int, p string")
    assert M.metrics(df).first()["accuracy"] == 1.0


def test_sets_and_table(rows):
    from pyspark.sql import functions as F

    roles = rows.withColumn("role", F.when(F.col("g") == "a", "train").otherwise("bounded"))
    got = by(M.evaluate_sets(roles), "dataset")
    assert got["train"]["bounds_accuracy"] is None and got["bounded"]["r2"] is None
    assert got["bounded"]["bounds_accuracy"] == 50.0
    table = {(r["truth"], r["predicted"], r["correct"]): r["n"] for r in M.truth_table(rows).collect()}
    assert table[(5, 5, True)] == 2 and table[(1, 2, False)] == 1


def test_fold_average(spark):
    df = spark.createDataFrame([(0, "t", 0.5, 1.0), (1, "t", 1.0, 3.0)], "fold int, set string, accuracy double, rmse double")
    r = M.fold_average(df).first()
    assert (r["accuracy"], r["rmse"]) == (0.75, 2.0)


def test_missing_predictions_give_no_finite_error(spark):
    data = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, float("nan")), ("a", 10, None), ("b", 1, 1.0), ("b", 3, 2.0)]
    df = spark.createDataFrame(data, "g string, y int, p double")
    for rounded in (True, False):
        got = by(M.metrics(df, by=["g"], rounded=rounded))
        assert (got["a"]["r2"], got["a"]["rmse"], got["a"]["accuracy"]) == (0.0, float("inf"), 0.5)
        assert got["b"]["r2"] == 0.5
