"""Runs taken up again from their rounds."""

from __future__ import annotations

import numpy as np
import pytest

from spantab.operators import boosting as B
from spantab.operators.boost_state import append_round, complete_rounds, durable_boost, resume, rounds_table


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    u, v = rng.uniform(1, 9, 300), rng.integers(1, 8, 300)
    y = np.floor(u + np.where(v > 4, 3, 0) + v % 3)
    rows = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(u, v, y)], "u double, v int, y double")
    bodies = ["row['u'] * 3", "row['v'] % 2", "row['u'] // 3", "row['v'] ** 2", "1 if row['v'] > 4 else 0", "row['v'] % 3",
              "log(row['u'])", "row['v'] % 3", "row['v'] // 2", "sqrt(row['u'])", "row['v'] % 5"]
    candidates = spark.createDataFrame(
        [(i, f"def f1(row): return {b}", f"n{i}", b, "") for i, b in enumerate(bodies)],
        "seq bigint, code_str string, name string, body string, reason string",
    )
    return rows.cache(), candidates


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on(spark, data, tmp_path):
    rows, candidates = data
    whole = B.boost_loop(rows, candidates, "y", B.start_run(rows, ["u"], "y", 1), 9)
    folder = str(tmp_path / "rounds")

    def stop(run):
        if run.iteration == 6:
            raise Stopped

    with pytest.raises(Stopped):
        durable_boost(rows, candidates, ["u"], "y", folder, 9, 1, on_round=stop)
    assert [k for k, _ in complete_rounds(spark, folder)] == list(range(7))
    # A round that was written but not marked counts for nothing.
    B.state_frame(whole, spark).write.parquet(f"{folder}/round-00000099-{'0' * 32}")
    run = durable_boost(rows, candidates, ["u"], "y", folder, 9, 1)
    assert run.accuracies == pytest.approx(whole.accuracies) and run.consumed == whole.consumed and run.queue == whole.queue
    assert [s.body for s in run.model.stages] == [s.body for s in whole.model.stages] and run.model.stages
    table = rounds_table(spark, folder).orderBy("iteration").collect()
    assert [r["iteration"] for r in table] == list(range(10))
    assert table[-1]["stages"] == len(run.model.stages) and table[-1]["accuracy"] == pytest.approx(run.accuracies[-1])


def test_an_empty_folder(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert resume(spark, folder) is None and rounds_table(spark, folder).count() == 0


def test_the_last_marked_round_wins(spark, data, tmp_path):
    rows, _ = data
    run = B.start_run(rows, ["u"], "y", 1)
    for iteration in (2, 10, 1):
        run.iteration = iteration
        append_round(run, spark, str(tmp_path / "r"))
    assert resume(spark, str(tmp_path / "r")).iteration == 10
