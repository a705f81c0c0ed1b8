"""Mini-batch steps beside plain numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spantab.operators import mlp as N
from spantab.operators.minibatch import batch_number, fit_minibatches, key_hash
from spantab.operators.splits import fit_splits


def test_batches_deal_all_rows_anew_each_epoch(spark):
    rows = spark.range(2000).withColumn("h", key_hash("id", 7))
    dealt = [
        {r["id"]: r["b"] for r in rows.select("id", batch_number(F.col("h"), 8, 7, e).alias("b")).collect()} for e in (1, 2)
    ]
    for one in dealt:
        sizes = np.bincount(list(one.values()), minlength=8)
        assert len(one) == 2000 and len(sizes) == 8 and sizes.min() > 180 and sizes.max() < 330
    assert np.mean([dealt[0][k] == dealt[1][k] for k in dealt[0]]) < 0.25


def test_steps_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    y = np.floor(2 * x[:, 0] - x[:, 1] + 3)
    df = spark.createDataFrame(
        [(f"k{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id string, a double, b double, y double"
    ).repartition(5)
    plan = fit_splits(df, "id", n=2)
    start = N.new_network(2, (5,), seed=3)
    fit = fit_minibatches(df, ["a", "b"], ["y"], plan, start, 3, 2, 0.05, "AdamW", 9)
    log = {(r["fold"], r["epoch"], r["role"]): tuple(r)[3:] for r in fit.log.collect()}
    assert len(log) == 2 * 3 * 3
    facts = df.select(
        "id", key_hash("id", 9).alias("h"), *(plan.role(f).alias(f"r{f}") for f in range(2)),
    )
    facts = facts.select("*", *(batch_number(F.col("h"), 3, 9, e).alias(f"b{e}") for e in (1, 2))).collect()
    facts = {r["id"]: r for r in facts}
    for f in range(2):
        net, update = start, N._Optimiser("AdamW", 0.05, len(start.weights))
        role = np.array([facts[f"k{i}"][f"r{f}"] for i in range(300)])
        for epoch in range(3):
            for b in range(3 if epoch else 0):
                batch = np.array([facts[f"k{i}"][f"b{epoch}"] for i in range(300)])
                own = (role == "train") & (batch == b)
                p, trace = net.forward(x[own])
                gap = 2 * (p - y[own, None])
                net = N.Network(net.sizes, update.step(net.weights, net.backward(trace, gap) / own.sum()), net.slope)
            for name in ("train", "valid", "test"):
                own = role == name
                p = net.forward(x[own])[0][:, 0]
                want = (own.sum(), np.mean((p - y[own]) ** 2), np.mean(np.floor(p + 0.5) == y[own]))
                np.testing.assert_allclose(log[f, epoch, name], want, rtol=1e-9)
        np.testing.assert_allclose(fit.networks[f].weights, net.weights, rtol=1e-9)
    best = max(range(3), key=lambda e: (log[0, e, "valid"][2], -e))
    assert (best == 2) == bool(np.allclose(fit.best[0].weights, fit.networks[0].weights))


def test_a_batch_without_rows_leaves_the_network(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 5.0, 1.0)], "id string, x double, y double")
    plan = fit_splits(df, "id", n=1, frac=0.0, test_frac=0.0)
    fit = fit_minibatches(df, ["x"], ["y"], plan, N.new_network(1, ()), 50, 1, 0.1, "SGD")
    assert {(r["role"], r["n"]) for r in fit.log.collect()} == {("train", 1)}  # one of 50 batches took a step
