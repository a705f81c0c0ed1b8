"""Queries over run logs; ``events`` is the log: user = run, time = order, value = measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators import runlog as G
from spantab.plans.proxy import table
from spantab.plans.registry import big, query, r6, settle

METRICS = ("click", "error", "purchase", "signup", "view")

_LOG = """WITH e AS (SELECT event_id, user_id, ts, value, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events) """


def _log(spark: SparkSession, sf_dir: str, run: tuple[str, ...] = ("user_id",)) -> G.OrderedLog:
    return G.ordered_log(table(spark, sf_dir, "events").drop("props"), run, ("ts", "event_id"))


_BEST = (
    "coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND 1 PRECEDING), {first})"
)


@query(
    "g1_new_best_flags",
    _LOG + f"SELECT event_id, {big('epoch')} AS epoch, {_BEST.format(first='true')} AS is_best FROM e",
)
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.new_best_flags(_log(spark, sf_dir)).select("event_id", "epoch", "is_best"))


@query(
    "g1_new_best_flags_late",
    _LOG + f"SELECT event_id, {big('epoch')} AS epoch, {_BEST.format(first='false')} AS is_best FROM e",
)
def g1_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = G.new_best_flags(_log(spark, sf_dir), first_counts=False)
    return settle(flags.select("event_id", "epoch", "is_best"))


@query(
    "g2_early_stop",
    _LOG + f""", b AS (SELECT user_id, epoch, {_BEST.format(first='true')} AS is_best FROM e),
l AS (SELECT user_id, epoch, max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS last
      FROM b),
s AS (SELECT user_id, max(epoch) AS epochs, min(CASE WHEN epoch - last >= 10 THEN epoch END) AS stop_epoch
      FROM l GROUP BY user_id)
SELECT s.user_id, {big('any_value(epochs)')} AS epochs, {big('any_value(stop_epoch)')} AS stop_epoch,
       {big('max(l.last)')} AS best_epoch
FROM s JOIN l ON s.user_id = l.user_id AND l.epoch <= coalesce(s.stop_epoch, s.epochs) GROUP BY s.user_id""",
)
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.early_stop(_log(spark, sf_dir), patience=10))


@query(
    "g3_best_epoch",
    _LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, epoch) AS rn FROM e)"
    f" SELECT user_id, {big('epoch')} AS best_epoch, {r6('value')} AS best_accuracy FROM r WHERE rn = 1",
)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.best_epoch(_log(spark, sf_dir)))


@query(
    "g4_best_so_far",
    _LOG + f"SELECT event_id, {big('epoch')} AS epoch, {r6('max(value) OVER w')} AS best,"
    f" {r6('max(value) OVER w - first_value(value) OVER w')} AS improvement FROM e"
    " WINDOW w AS (PARTITION BY user_id ORDER BY epoch)",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.best_so_far(_log(spark, sf_dir)).select("event_id", "epoch", "best", "improvement"))


@query(
    "g5_cap_queue",
    """WITH q AS (SELECT user_id, event_id, md5('42:' || event_id::varchar) AS h,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age,
  count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, age <= 8 ORDER BY h, event_id) AS draw FROM q)
SELECT user_id, event_id FROM d WHERE n <= 15 OR age <= 8 OR draw <= 7""",
)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").select("user_id", "event_id")
    return settle(G.cap_queue(queue, ["user_id"], "event_id"))


@query(
    "g6_epoch_table",
    """WITH e AS (SELECT user_id, event_type, value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS epoch FROM events)
SELECT user_id, epoch::bigint AS epoch, """
    + ", ".join(f"{r6(f'''max(CASE WHEN event_type = '{m}' THEN value END)''')} AS {m}" for m in METRICS)
    + " FROM e GROUP BY user_id, epoch",
)
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _log(spark, sf_dir, ("user_id", "event_type")).numbered().rows
    return settle(G.epoch_table(long, ["user_id"], METRICS, metric="event_type"))


@query(
    "f10_batch_mean",
    _LOG + f""", b AS (SELECT user_id, (epoch - 1) // 64 AS batch, avg(value) AS m, sum(value) AS s, count(*) AS n
  FROM e GROUP BY 1, 2)
SELECT user_id, {r6('avg(m)')} AS batch_mean, {r6('sum(s) / sum(n)')} AS row_mean, count(*)::bigint AS batches
FROM b GROUP BY user_id""",
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(G.batch_mean(_log(spark, sf_dir)))
