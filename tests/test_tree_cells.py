"""Histogram cells of trees, and correlations of a design, against plain numpy."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spantab.operators import boosted_trees as BT
from spantab.operators.linear import Design, design_correlations

ROWS = [(f"k{i}", float(i % 4), [i % 3, i % 5], [0.5, 1.0], [f for f in range(2) if (i + f) % 3]) for i in range(200)]


def cells_by_hand(tree, level, features):
    out = defaultdict(lambda: [0.0, 0])
    for _, y, bins, p, folds in ROWS:
        for fold in folds:
            at = 0
            for _ in range(level):
                place = fold * tree.size + at
                if tree.feature[place] >= 0:
                    at = 2 * at + 1 + (bins[tree.feature[place]] >= tree.cut[place])
            if at >= 2**level - 1:
                for f in features or [0]:
                    cell = out[fold, at, f, bins[f] if features else 0]
                    cell[0] += p[fold] - y
                    cell[1] += 1
    return {k: (pytest.approx(g), h) for k, (g, h) in out.items()}


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_cells_without_a_row_per_fold_and_feature(spark, monkeypatch, dense):
    monkeypatch.setattr(BT, "DENSE_CELLS", dense)
    rows = spark.createDataFrame(
        ROWS, "key string, y double, bins array<int>, p array<double>, folds array<int>"
    ).repartition(3)
    model = BT.TreeModel(("a", "b"), ((1.0, 2.0), (1.0, 2.0, 3.0, 4.0)), [0.5, 1.0], 0.3, 2, (True, True))
    tree = BT.Tree.bare(2, 2)
    tree.feature[0], tree.cut[0], tree.feature[tree.size], tree.cut[tree.size] = 1, 2, 0, 1
    for level, drawn in [(0, [0, 1]), (1, [1]), (1, [])]:
        made = BT._cells(rows, model, tree, level, [], drawn, 5)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
        found = made.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        assert {(r["fold"], r["node"], r["feature"], r["bin"]): (r["g"], r["h"]) for r in found} == cells_by_hand(tree, level, drawn)


def test_design_correlations_are_those_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(50, 4, (300, 2)), 3)
    r = np.round(x[:, 0] ** 2 - 3 * x[:, 1] + rng.normal(0, 5, 300), 3)
    df = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, r)] + [(1.0, 2.0, None)], "a double, b double, r double")
    found = design_correlations(df.repartition(3), Design(("a", "b"), 2), F.col("r"))
    wide = Design(("a", "b"), 2).expand(x)
    assert found == pytest.approx([np.corrcoef(c, r)[0, 1] for c in wide.T], abs=1e-9)


def test_a_constant_column_leans_on_nothing(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, r double")
    found = design_correlations(df, Design(("a",), 1), F.col("r"))
    assert not (np.abs(found) > 1e-6).any()
