"""Queries over feature preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators import features as D
from spantab.operators.trials import trial_grid
from spantab.plans.proxy import CATEGORICAL, LISTS, NUMERICAL, TYPED_SQL, table, typed
from spantab.plans.registry import big, query, r6, settle

_TYPED = f"WITH t AS ({TYPED_SQL}) "


@query(
    "d1_scaler",
    _TYPED + ", s AS (SELECT " + ", ".join(
        f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMERICAL)
    ) + " FROM t) SELECT id, " + ", ".join(
        r6(f"({c} - m{i}) / s{i}") + f" AS {c}" for i, c in enumerate(NUMERICAL)
    ) + " FROM t CROSS JOIN s",
)
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select("id", *NUMERICAL)
    return settle(D.apply_scaler(rows, D.fit_scaler(rows, NUMERICAL)))


_TEXT_SQL = (
    "CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE 'nan' END",
    "coalesce({c}::varchar, 'nan')",
)


def _encoded_sql() -> str:
    items = [
        f"{big(f'dense_rank() OVER (ORDER BY {_TEXT_SQL[0].format(c=c)}) - 1')} AS {c}_code" for c in CATEGORICAL
    ]
    items.append(big(f"dense_rank() OVER (ORDER BY {_TEXT_SQL[1].format(c='level')}) - 1") + " AS level_code")
    return ", ".join(items)


@query("d2_encoder", _TYPED + f"SELECT id, {_encoded_sql()} FROM t")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*CATEGORICAL, "level"]
    rows = typed(spark, sf_dir).select("id", *columns)
    coded = D.apply_encoder(rows, D.fit_encoder(rows, columns), columns)
    return settle(coded.select("id", *(f"{c}_code" for c in columns)))


@query(
    "d3_cardinalities",
    _TYPED + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::bigint AS cardinality FROM t"
        for c in (*CATEGORICAL, "level", "log_conductor")
    ),
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(D.cardinalities(typed(spark, sf_dir), [*CATEGORICAL, "level", "log_conductor", "absent"]))


@query(
    "d4_list_vector",
    _TYPED + "SELECT id, array_to_string(list_resize(list_concat(canonical_conjugator,"
    " coalesce(flatten(conductor), []::int[])), 8, 0), ',') AS list_vector FROM t",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select("id", *LISTS)
    return settle(D.list_vector(rows, LISTS, 8).select("id", "list_vector"))


@query(
    "d5_max_list_len",
    _TYPED + f"SELECT {big('max(len(canonical_conjugator) + coalesce(len(flatten(conductor)), 0))')}"
    " AS max_list_len FROM t",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(D.max_list_len(typed(spark, sf_dir), LISTS))


_POLY = ("level", "genus", "cusps")


def _poly_sql() -> str:
    items = []
    for powers, name in zip(D.exponents(3, 2), D.monomial_names(_POLY, 2)):
        product = " * ".join(f"{c}::double" for c, e in zip(_POLY, powers) for _ in range(e))
        items.append(f"{r6(f'sum({product})')} AS \"{name}\"")
    return ", ".join(items)


@query("d6_poly_expand", _TYPED + f"SELECT pointless, {_poly_sql()} FROM t GROUP BY pointless")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.poly_expand(typed(spark, sf_dir), _POLY, 2)
    sums = [F.sum(F.get("poly", i)).alias(n) for i, n in enumerate(D.monomial_names(_POLY, 2))]
    return settle(rows.groupBy("pointless").agg(*sums))


_REPORTED = ("level", "log_conductor", "canonical_conjugator", "pointless")


@query(
    "d7_nan_report",
    _TYPED + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::bigint AS missing,"
        f" count(*) FILTER (WHERE {c} IS NULL) > 0 AS any_missing FROM t" for c in _REPORTED
    ),
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(D.nan_report(typed(spark, sf_dir), _REPORTED))


@query(
    "d8_assemble",
    _TYPED + f"SELECT {big('count(*)')} AS n, {r6('sum(level + genus + cusps)')} AS num_sum,"
    f" {big('sum(pointless::int)')} AS cat_sum, {r6('sum(list_sum(canonical_conjugator))')} AS lst_sum FROM t",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.list_vector(typed(spark, sf_dir), ["canonical_conjugator"], 4)
    sample = D.assemble(rows, ["level", "genus", "cusps"], ["pointless"], "list_vector", keep=["id"])

    def total(c: str) -> Column:
        return F.sum(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x))

    return settle(
        sample.agg(
            F.count("id").alias("n"), total("num").alias("num_sum"),
            F.sum("cat.pointless").alias("cat_sum"), total("lst").alias("lst_sum"),
        )
    )


GRID = {
    "batch_size": [32, 64],
    "learning_rate": [0.0001, 0.001],
    "optimizer": ["Adam", "SGD"],
}


@query(
    "e14_trial_grid",
    "SELECT s_suppkey, batch_size::bigint AS batch_size, learning_rate::double AS learning_rate, optimizer,"
    " fold::bigint AS fold FROM supplier, (SELECT unnest([32, 64]) AS batch_size) a,"
    " (SELECT unnest([0.0001::double, 0.001::double]) AS learning_rate) b,"
    " (SELECT unnest(['Adam', 'SGD']) AS optimizer) c, (SELECT unnest(range(5)) AS fold) d",
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(trial_grid(GRID, 5, table(spark, sf_dir, "supplier").select("s_suppkey")))
