"""Analytics over ordered run logs: running best values, early stopping, epoch tables.

Running values use an ordinary window per run while every run fits a task. A
log with a larger run is range-partitioned on (run, order) instead, so any run
is cut into blocks of bounded size; blocks are scanned on their own and the
totals of earlier blocks are carried in. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantab.staging import stage

MAX_RUN_ROWS = 5_000_000
_BLOCK = "_block"


@dataclass(frozen=True)
class OrderedLog:
    """Rows of many runs; ``order`` is unique inside a run."""

    df: DataFrame
    run: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool

    def running(self, name: str, value: Column, how: str, inclusive: bool = True) -> OrderedLog:
        """Add the running ``min``, ``max`` or ``count`` of ``value`` in run order."""
        function = {"min": F.min, "max": F.max, "count": F.count}[how]
        keys = [*self.run, _BLOCK] if self.blocked else list(self.run)
        scan = Window.partitionBy(*keys).orderBy(*self.order)
        scan = scan.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if not self.blocked:
            return replace(self, df=self.df.withColumn(name, function(value).over(scan)))
        before = Window.partitionBy(*self.run).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carry_function = F.sum if how == "count" else function
        totals = self.df.groupBy(*self.run, _BLOCK).agg(function(value).alias("_total"))
        carried = totals.select(*self.run, _BLOCK, carry_function("_total").over(before).alias("_carry"))
        local = function(value).over(scan)
        if how == "count":
            combined = local + F.coalesce(F.col("_carry"), F.lit(0))
        elif how == "min":
            combined = F.when(F.col("_carry") < local, F.col("_carry")).otherwise(F.coalesce(local, F.col("_carry")))
        else:
            combined = F.when(F.col("_carry") > local, F.col("_carry")).otherwise(F.coalesce(local, F.col("_carry")))
        joined = self.df.join(carried, [*self.run, _BLOCK])
        return replace(self, df=joined.withColumn(name, combined).drop("_carry"))

    def numbered(self, name: str = "epoch") -> OrderedLog:
        """Add the 1-based position of each row in its run."""
        return self.running(name, F.lit(1), "count")

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(_BLOCK)


def ordered_log(
    df: DataFrame, run: str | Sequence[str], order: str | Sequence[str], max_run_rows: int = MAX_RUN_ROWS
) -> OrderedLog:
    """Wrap a log; one narrow count per run decides whether runs are cut into blocks."""
    runs = (run,) if isinstance(run, str) else tuple(run)
    orders = (order,) if isinstance(order, str) else tuple(order)
    longest = df.groupBy(*runs).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= max_run_rows:
        return OrderedLog(df, runs, orders, blocked=False)
    blocks = df.repartitionByRange(*runs, *orders).withColumn(_BLOCK, F.spark_partition_id())
    return OrderedLog(stage(blocks, "runlog"), runs, orders, blocked=True)


def _flagged(log: OrderedLog, loss: str, first_counts: bool) -> OrderedLog:
    with_min = log.numbered().running("_earlier", F.col(loss), "min", inclusive=False)
    flag = F.when(F.col("epoch") == 1, F.lit(first_counts)).otherwise(
        F.coalesce(F.col(loss) < F.col("_earlier"), F.lit(False))
    )
    return replace(with_min, df=with_min.df.withColumn("is_best", flag).drop("_earlier"))


def new_best_flags(log: OrderedLog, loss: str = "value", first_counts: bool = True) -> DataFrame:
    """Add ``epoch`` and ``is_best``: the loss is below all earlier ones of the run."""
    return _flagged(log, loss, first_counts).rows


def early_stop(log: OrderedLog, patience: int, loss: str = "value") -> DataFrame:
    """Per run: epochs seen, first epoch ``patience`` epochs after the best, and the best until then.

    ``stop_epoch`` is null for a run that never stops early. At the stop the
    best epoch lies exactly ``patience`` back.
    """
    flagged = _flagged(log, loss, first_counts=True)
    last = flagged.running("_last", F.when(F.col("is_best"), F.col("epoch")), "max")
    stopped = F.col("epoch") - F.col("_last") >= patience
    per_run = last.df.groupBy(*log.run).agg(
        F.max("epoch").alias("epochs"),
        F.min(F.when(stopped, F.col("epoch"))).alias("stop_epoch"),
        F.max("_last").alias("_best"),
    )
    best = F.coalesce(F.col("stop_epoch") - F.lit(patience), F.col("_best"))
    return per_run.withColumn("best_epoch", best).drop("_best")


def best_epoch(log: OrderedLog, accuracy: str = "value") -> DataFrame:
    """First epoch (1-based) with the highest accuracy, per run; a map-side combined minimum."""
    numbered = log.numbered().df.filter(F.col(accuracy).isNotNull())
    best = numbered.groupBy(*log.run).agg(
        F.min(F.struct((-F.col(accuracy)).alias("minus"), F.col("epoch"))).alias("b")
    )
    return best.select(*log.run, F.col("b.epoch").alias("best_epoch"), (-F.col("b.minus")).alias("best_accuracy"))


def best_so_far(log: OrderedLog, accuracy: str = "value") -> DataFrame:
    """Add ``epoch``, the running best and its gain over the first row of the run."""
    numbered = log.numbered().running("best", F.col(accuracy), "max")
    first = numbered.running("_first", F.struct("epoch", accuracy), "min")
    gain = F.col("best") - F.col(f"_first.{accuracy}")
    return replace(first, df=first.df.withColumn("improvement", gain).drop("_first")).rows


def cap_queue(
    df: DataFrame, run: Sequence[str], order: str, cap: int = 15, seed: int = 42
) -> DataFrame:
    """Queues longer than ``cap``: the newest ``ceil(cap/2)`` and ``cap // 2`` drawn older entries.

    Every step ranks with a per-group limit, which Spark applies before the
    shuffle: at most ``2.5 * cap`` rows of a queue ever meet in a task. The
    drawn older entries are among the ``cap`` smallest hashes of the whole
    queue, since at most ``cap - cap // 2`` of those are newest ones.
    """
    newest, older = cap - cap // 2, cap // 2
    keyed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))))
    by_age = Window.partitionBy(*run).orderBy(F.col(order).desc())
    by_hash = Window.partitionBy(*run).orderBy("_h", order)
    recent = keyed.withColumn("_r", F.row_number().over(by_age)).filter(F.col("_r") <= newest).drop("_r")
    drawn = keyed.withColumn("_r", F.row_number().over(by_hash)).filter(F.col("_r") <= cap).drop("_r")
    few = recent.unionByName(drawn).dropDuplicates([*run, order])
    sizes = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    ranked = few.join(sizes, list(run)).withColumn("_age", F.row_number().over(by_age))
    is_new = F.col("_age") <= newest
    by_draw = Window.partitionBy(*run, is_new).orderBy("_h", order)
    keep = (F.col("_n") <= cap) | is_new | (F.col("_draw") <= older)
    return ranked.withColumn("_draw", F.row_number().over(by_draw)).filter(keep).select(*df.columns)


def epoch_table(
    df: DataFrame, run: Sequence[str], names: Sequence[str], epoch: str = "epoch", metric: str = "metric",
    value: str = "value",
) -> DataFrame:
    """Long log to one row per (run, epoch) with a column per metric."""
    return df.groupBy(*run, epoch).agg(
        *(F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names)
    )


def incomplete_metrics(df: DataFrame, run: Sequence[str], epochs: int, metric: str = "metric") -> DataFrame:
    """Metrics whose number of rows is not the number of epochs, per run."""
    return df.groupBy(*run, metric).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != epochs)


def batch_mean(log: OrderedLog, value: str = "value", batch: int = 64) -> DataFrame:
    """Per run: unweighted mean of batch means, beside the mean over rows."""
    numbered = log.numbered("_i").df
    batches = numbered.groupBy(*log.run, F.floor((F.col("_i") - 1) / batch).alias("_batch")).agg(
        F.avg(value).alias("_mean"), F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    return batches.groupBy(*log.run).agg(
        F.avg("_mean").alias("batch_mean"),
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("row_mean"),
        F.count(F.lit(1)).alias("batches"),
    )
