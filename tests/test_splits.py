from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spantab.operators import splits as S


def brute_inside(keys, seed, size):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], k))
    return set(order[:size])


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_exact_size_and_independent_of_partitions(spark, parts):
    df = spark.range(1009).repartition(parts)
    got = {r["id"] for r in S.holdout(df, "id", 0.1).filter("is_test").collect()}
    assert got == brute_inside(range(1009), 42, math.ceil(1009 * 0.1))


@pytest.mark.parametrize("limit", [1, 3, 100_000])
def test_refinement_steps_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "RANK_LIMIT", limit)
    (cut,) = S.fit_cuts(spark.range(5000), "id", [7], 1 / 9)
    got = {r["id"] for r in spark.range(5000).filter(cut.inside("id")).collect()}
    assert got == brute_inside(range(5000), 7, math.ceil(5000 / 9))
    assert (cut.size, cut.total) == (len(got), 5000)


def test_hot_key_counts_once(spark):
    keys = spark.range(300).union(spark.range(2000).select(F.lit(5).cast("bigint").alias("id")))
    (cut,) = S.fit_cuts(keys, "id", [42], 0.1)
    assert (cut.size, cut.total) == (30, 300)


def test_empty_and_tiny(spark):
    empty = spark.range(0)
    assert S.holdout(empty, "id").count() == 0
    assert S.holdout(spark.range(1), "id").filter("is_test").count() == 1


def test_roles(spark):
    df = spark.range(900)
    plan = S.fit_splits(df, "id", n=3)
    rows = plan.membership(df).collect()
    assert len(rows) == 2700
    by_fold = {}
    for r in rows:
        by_fold.setdefault(r["fold"], {}).setdefault(r["role"], set()).add(r["id"])
    for roles in by_fold.values():
        assert len(roles["test"]) == 90 and len(roles["valid"]) == 90 and len(roles["train"]) == 720
        assert roles["test"] == by_fold[0]["test"]
    assert by_fold[0]["valid"] & by_fold[1]["valid"]  # fresh draws overlap
    rest = set(range(900)) - by_fold[0]["test"]
    assert by_fold[1]["valid"] == brute_inside(rest, 43, 90)


def test_dedup_first_keeps_first_and_matches_nulls(spark):
    df = spark.createDataFrame(
        [("b", 6, [1, 2], "late"), ("a", 6, [1, 2], "early"), ("c", None, None, "n1"), ("d", None, None, "n2")],
        "id string, level int, l array<int>, t string",
    )
    got = {(r["id"], r["t"]) for r in S.dedup_first(df, ["level", "l"], "id").collect()}
    assert got == {("a", "early"), ("c", "n1")}
    assert S.dedup_first(df, ["level", "l"], "id").columns == df.columns


def test_dedup_order_key_inside_subset(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, t string")
    assert sorted(tuple(r) for r in S.dedup_first(df, ["id"], "id").collect()) == [(1, "x"), (2, "z")]


def test_dedup_combines_hot_groups_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    plan = S.dedup_first(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min") >= 1


def test_shift_split(spark):
    df = spark.range(100).withColumn("level", (F.col("id") % 50).cast("int"))
    counts = {r["role"]: r["count"] for r in S.shift_split(df, "id", "level", 30).groupBy("role").count().collect()}
    assert counts == {"test": 40, "valid": 7, "train": 53}


def test_weak_sets(spark):
    df = spark.createDataFrame([(i, [1, 1 + i % 2]) for i in range(200)], "id long, q_gonality_bounds array<int>")
    exact, bounded = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    sets = S.weak_sets(exact, bounded, S.fit_splits(exact, "id", 1), S.fit_splits(bounded, "id", 1))
    counts = {(r["source"], r["role"]): r["count"] for r in sets.groupBy("source", "role").count().collect()}
    assert counts[("exact", "test")] == counts[("bounded", "test")] == 10
    assert sets.filter("source = 'bounded' AND q_gonality_upper = 2").count() == 100


def test_rows_without_a_key_belong_to_no_set(spark):
    df = spark.createDataFrame([(i,) for i in range(40)] + [(None,)] * 3, "id int")
    plan = S.fit_splits(df, "id", n=2)
    roles = plan.with_role(df, 0).collect()
    assert all((r.role is None) == (r.id is None) for r in roles)


def _repeats(spark):
    rng = random.Random(21)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice([None, "a", "x"]), rng.choice([None, 1, 2, 3, 4]), i % 50 or None, f"p{i}")
            for i in range(900)]
    return spark.createDataFrame(rows, "k string, l string, m int, o int, payload string").repartition(5)


def test_first_by_number_equals_first(spark, monkeypatch):
    df = _repeats(spark)  # 50 order values for 900 rows: many ties
    want = sorted(map(repr, S.dedup_first(df, ["k", "l", "m"], "o").collect()))
    assert sorted(map(repr, S.dedup_first_number(df, ["k", "l", "m"], "o").collect())) == want
    plain = F.xxhash64
    # the two group hashes clash for all keys with one value of m; the third one tells
    monkeypatch.setattr(F, "xxhash64", lambda k, *c: plain(k, c[4]) if k._jc.toString() != "2" else plain(k, *c))
    assert sorted(map(repr, S.dedup_first_number(df, ["k", "l", "m"], "o").collect())) == want


def test_first_by_number_does_not_sort_groups(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("k"), "id", F.col("id").cast("string").alias("v"))
    spark.sparkContext.setJobGroup("plans", "plans")
    out = S.dedup_first_number(df, ["k"], "id")
    assert out.count() == 700 and out.agg(F.max("id")).first()[0] == 699
    marks = [F.col("k"), F.col("k").isNull()]
    grouped = df.groupBy(F.xxhash64(F.lit(0), *marks), F.xxhash64(F.lit(1), *marks)).agg(F.min("id"), F.min(F.xxhash64(F.lit(2), *marks)))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in S.dedup_first(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
