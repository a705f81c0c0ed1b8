"""Boosting runs that survive their driver: an append-only table of rounds.

Every round is written to a folder of its own, and only then named by an empty
marker file, which the file system makes in one step. A folder without a marker
is a round that did not finish; it is passed over. Nothing is ever overwritten.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.operators.boosting import STATE_SCHEMA, BoostRun, boost_loop, load_state, start_run, state_frame
from spantab.sources.chunks import _file_system

_DONE = "done"
_MARKER = re.compile(r"round-(\d+)-([0-9a-f]{32})")


def append_round(run: BoostRun, spark: SparkSession, folder: str) -> None:
    """Write the state of the run's last round, then its marker."""
    name = f"round-{run.iteration:08d}-{uuid.uuid4().hex}"
    state_frame(run, spark).write.parquet(f"{folder}/{name}")
    fs, marker = _file_system(spark, f"{folder}/{_DONE}/{name}")
    fs.mkdirs(marker.getParent())
    fs.create(marker, False).close()


def complete_rounds(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(round, folder) of the rounds with a marker, in order; the first of equal ones by name."""
    fs, done = _file_system(spark, f"{folder}/{_DONE}")
    if not fs.exists(done):
        return []
    found = (_MARKER.fullmatch(s.getPath().getName()) for s in fs.listStatus(done))
    return sorted((int(m.group(1)), f"{folder}/{m.group(0)}") for m in found if m)


def rounds_table(spark: SparkSession, folder: str) -> DataFrame:
    """(iteration, consumed, stages, accuracy, best_accuracy) of every complete round."""
    paths = [path for _, path in complete_rounds(spark, folder)]
    schema = T.StructType.fromDDL(STATE_SCHEMA)
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.select(
        "iteration", "consumed", F.size("model.stages").alias("stages"),
        F.col("model.current_accuracy").alias("accuracy"), F.col("best_model.current_accuracy").alias("best_accuracy"),
    )


def resume(spark: SparkSession, folder: str) -> BoostRun | None:
    """The run as its last complete round left it, None without any."""
    rounds = complete_rounds(spark, folder)
    return load_state(spark, rounds[-1][1], restore_best=False) if rounds else None


def durable_boost(
    df: DataFrame, candidates: DataFrame, base_features: list[str], y: str, folder: str, rounds: int = 20,
    degree: int = 3, on_round: Callable[[BoostRun], None] | None = None, **options,
) -> BoostRun:
    """:func:`boost_loop` whose rounds are kept in ``folder``; called again, it goes on after the last complete one.

    Candidates are read in order of ``seq``, draws are seeded, and the design's
    factor is made anew, so a resumed run takes the decisions of an
    uninterrupted one.
    """
    spark = df.sparkSession
    run = resume(spark, folder)
    if run is None:
        run = start_run(df, base_features, y, degree)
        append_round(run, spark, folder)

    def keep(state: BoostRun) -> None:
        append_round(state, spark, folder)
        if on_round is not None:
            on_round(state)

    return boost_loop(df, candidates, y, run, rounds, on_round=keep, **options)
