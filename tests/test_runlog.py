from __future__ import annotations

import pytest

from spantab.operators import runlog as G


@pytest.fixture(scope="module")
def log_frame(spark):
    """One run holds most rows; values tie, rise and fall."""
    rows = [("hot", i, float((i * 37) % 101)) for i in range(900)]
    rows += [("small", i, float(10 - i)) for i in range(5)] + [("one", 0, 3.0)]
    return spark.createDataFrame(rows, "run string, step long, value double").repartition(6).cache()


@pytest.fixture(params=[5_000_000, 20], ids=["windows", "blocks"])
def log(log_frame, request):
    made = G.ordered_log(log_frame, "run", "step", max_run_rows=request.param)
    assert made.blocked == (request.param == 20)
    return made


def runs(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["step"]):
        out.setdefault(r["run"], []).append(r)
    return out


def test_flags_and_numbers(log, log_frame):
    for late in (True, False):
        for run, rows in runs(G.new_best_flags(log, first_counts=late)).items():
            best = None
            for i, r in enumerate(rows):
                assert r["epoch"] == i + 1
                assert r["is_best"] == (late if i == 0 else r["value"] < best), run
                best = r["value"] if best is None else min(best, r["value"])


@pytest.mark.parametrize("patience", [1, 3, 60, 1000])
def test_early_stop_follows_the_loop(log, log_frame, patience):
    got = {r["run"]: (r["epochs"], r["stop_epoch"], r["best_epoch"]) for r in G.early_stop(log, patience).collect()}
    for run, rows in runs(log_frame).items():
        best, at, waited, stop = float("inf"), None, 0, None
        for epoch, r in enumerate(rows, 1):
            if r["value"] < best:
                best, at, waited = r["value"], epoch, 0
            else:
                waited += 1
            if waited >= patience:
                stop = epoch
                break
        assert got[run] == (len(rows), stop, at)


def test_best_values(log, log_frame):
    per_run = {r["run"]: (r["best_epoch"], r["best_accuracy"]) for r in G.best_epoch(log).collect()}
    seen = runs(G.best_so_far(log))
    for run, rows in runs(log_frame).items():
        values = [r["value"] for r in rows]
        assert per_run[run] == (values.index(max(values)) + 1, max(values))
        for i, r in enumerate(seen[run]):
            assert r["best"] == max(values[: i + 1]) and r["improvement"] == max(values[: i + 1]) - values[0]


def test_batch_mean(log, log_frame):
    got = {r["run"]: r for r in G.batch_mean(log, batch=64).collect()}
    for run, rows in runs(log_frame).items():
        values = [r["value"] for r in rows]
        parts = [values[i : i + 64] for i in range(0, len(values), 64)]
        means = [sum(p) / len(p) for p in parts]
        assert got[run]["batch_mean"] == pytest.approx(sum(means) / len(means))
        assert got[run]["row_mean"] == pytest.approx(sum(values) / len(values))
        assert got[run]["batches"] == len(parts)


def test_cap_queue(log_frame):
    kept = runs(G.cap_queue(log_frame, ["run"], "step"))
    assert len(kept["hot"]) == 15 and [r["step"] for r in kept["hot"]][-8:] == list(range(892, 900))
    assert len(kept["small"]) == 5 and len(kept["one"]) == 1


def test_cap_queue_limits_groups_before_the_shuffle(log_frame):
    plan = G.cap_queue(log_frame, ["run"], "step")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_epoch_table(spark):
    rows = [("r", e, m, float(e * 10 + k)) for e in (1, 2) for k, m in enumerate(("train", "valid")) if (e, m) != (2, "valid")]
    df = spark.createDataFrame(rows, "run string, epoch int, metric string, value double")
    got = {r["epoch"]: (r["train"], r["valid"]) for r in G.epoch_table(df, ["run"], ["train", "valid"]).collect()}
    assert got == {1: (10.0, 11.0), 2: (20.0, None)}
    assert [r["metric"] for r in G.incomplete_metrics(df, ["run"], 2).collect()] == ["valid"]
