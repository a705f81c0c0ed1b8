from __future__ import annotations

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantab.operators import features as D
from spantab.operators import quantiles as Q
from spantab.operators.trials import trial_grid


def test_scaler_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, 1.0), (6.0, 5, 3.0)], "a double, b int, c double")
    scaler = D.fit_scaler(df, ["a", "b", "c"])
    assert scaler[0].std_pop == pytest.approx(np.std([1, 2, 6]))
    assert (scaler[1].divisor, scaler[2].mean) == (1.0, 2.0)
    got = D.apply_scaler(df, scaler).collect()
    assert [r["b"] for r in got] == [0.0, 0.0, 0.0]
    assert got[0]["c"] is None


def test_encoder_sorted_and_strict(spark):
    df = spark.createDataFrame([(True, "b"), (False, "a"), (None, "10"), (True, "9")], "f boolean, t string")
    table = D.fit_encoder(df, ["f", "t"])
    codes = {(r["column"], r["class"]): r["code"] for r in table.collect()}
    assert codes == {
        ("f", "False"): 0, ("f", "True"): 1, ("f", "nan"): 2, ("t", "10"): 0, ("t", "9"): 1, ("t", "a"): 2, ("t", "b"): 3,
    }
    got = {(r["f_code"], r["t_code"]) for r in D.apply_encoder(df, table, ["f", "t"]).collect()}
    assert got == {(1, 3), (0, 2), (2, 0), (1, 1)}
    unseen = spark.createDataFrame([(True, "new")], "f boolean, t string")
    with pytest.raises(Exception, match="unseen class in t: new"):
        D.apply_encoder(unseen, table, ["t"]).collect()


def test_encoder_gives_the_same_by_map_and_by_join(spark, monkeypatch):
    rows = [(True, f"c{i % 7}", i) for i in range(50)] + [(None, None, 99)]
    df = spark.createDataFrame(rows, "f boolean, t string, i int")
    table = D.fit_encoder(df, ["f", "t"])
    mapped = D.apply_encoder(df, table, ["f", "t"])
    monkeypatch.setattr(D, "LITERAL_CLASSES", 2)  # f stays a map, t is joined
    joined = D.apply_encoder(df, table, ["f", "t"])
    assert mapped.dtypes == joined.dtypes and sorted(mapped.collect(), key=repr) == sorted(joined.collect(), key=repr)
    unseen = spark.createDataFrame([(True, "new", 1)], df.schema)
    with pytest.raises(Exception, match="unseen class in t: new"):
        D.apply_encoder(unseen, table, ["t"]).collect()
    assert D.apply_encoder(df.limit(0), table, ["f", "t"]).count() == 0


def test_large_code_table_is_numbered_in_blocks(spark, monkeypatch):
    df = spark.range(5000).select(F.concat(F.lit("same prefix "), F.col("id").cast("string")).alias("t"))
    small = {r["class"]: r["code"] for r in D.fit_encoder(df, ["t"]).collect()}
    monkeypatch.setattr(D, "SMALL_CODE_TABLE", 10)
    large = {r["class"]: r["code"] for r in D.fit_encoder(df, ["t"]).collect()}
    assert small == large and sorted(large.values()) == list(range(5000))


def test_cardinalities(spark):
    df = spark.createDataFrame([(1, "x", None), (1, None, None), (2, "y", None)], "a int, b string, c double")
    got = {r["column"]: r["cardinality"] for r in D.cardinalities(df, ["a", "b", "c", "absent"]).collect()}
    assert got == {"a": 2, "b": 2, "c": 0}
    near = {r["column"]: r["cardinality"] for r in D.cardinalities(df, ["a", "b"], approximate=True).collect()}
    assert near == {"a": 2, "b": 2}


def test_list_vector_cuts_and_pads(spark):
    df = spark.createDataFrame(
        [([1, 2], [[2, 3], [5, 1]]), ([1, 2, 3, 4], []), (None, None)], "a array<int>, b array<array<int>>"
    )
    got = [r["list_vector"] for r in D.list_vector(df, ["a", "b"], 5).collect()]
    assert got == [[1, 2, 2, 3, 5], [1, 2, 3, 4, 0], [0] * 5]
    assert D.max_list_len(df, ["a", "b"]).first()[0] == 6


def test_monomials():
    assert D.monomial_names(["x", "y"], 3) == [
        "x", "y", "x^2", "x y", "y^2", "x^3", "x^2 y", "x y^2", "y^3",
    ]
    assert len(D.exponents(8, 3)) == 164


def test_poly_expand_values(spark):
    df = spark.createDataFrame([(2, 3)], "x int, y int")
    assert D.poly_expand(df, ["x", "y"], 3).first()["poly"] == [2, 3, 4, 6, 9, 8, 12, 18, 27]


def test_nan_report(spark):
    df = spark.createDataFrame([(1.0, [1.0, float("nan")]), (float("nan"), [1.0])], "v double, l array<double>")
    got = {r["column"]: r["missing"] for r in D.nan_report(df).collect()}
    assert got == {"v": 1, "l": 1}


@pytest.mark.parametrize("bins", [4096, 4])
def test_exact_median(spark, monkeypatch, bins):
    monkeypatch.setattr(Q, "RANGE_BINS", bins)
    monkeypatch.setattr(Q, "MIN_BINS", min(bins, Q.MIN_BINS))
    rng = np.random.default_rng(1)
    heavy = np.concatenate([np.exp(rng.normal(0, 8, 301)), np.full(150, 2.0)])
    even = rng.integers(0, 9, 200).astype(float)
    rows = [(float(a), float(b)) for a, b in zip(heavy, np.resize(even, len(heavy)))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    got = Q.exact_medians(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")})
    assert got["a"] == statistics.median(r[0] for r in rows)
    assert got["b"] == statistics.median(r[1] for r in rows)
    assert got["none"] == 0.0
    pair = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    assert Q.exact_medians(pair, {"a": F.col("a")})["a"] == 2.5


def test_trial_grid(spark):
    grid = trial_grid({"hidden": [[128, 32], [8]], "rate": [0.1, 0.2]}, 3, spark.range(2))
    assert grid.count() == 2 * 2 * 2 * 3
    assert grid.columns == ["id", "hidden", "rate", "fold"]
