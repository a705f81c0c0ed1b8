"""Queries over the row-cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators import cleaning as C
from spantab.plans.proxy import CURVES_SQL, TYPED_SQL, curves, table, typed
from spantab.plans.registry import big, query, r6, settle

_CURVES = f"WITH curves AS ({CURVES_SQL}) "
_TYPED = f"WITH t AS ({TYPED_SQL}) "

# Orders with dirty text cells, stated once for both engines.
DIRTY = {
    "o_orderkey": "o_orderkey",
    "priority": "concat(' \t', o_orderpriority, '  ')",
    "status": "CASE o_orderkey % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'null' WHEN 2 THEN 'N/A' WHEN 3 THEN 'NaN'"
    " WHEN 4 THEN '' ELSE o_orderstatus END",
    "price": "CASE o_orderkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN ' 4.5 ' ELSE cast(o_totalprice AS string) END",
}
DIRTY_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in DIRTY.items()) + " FROM orders"
_DIRTY = f"WITH d AS ({DIRTY_SQL}) "


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in DIRTY.items()))


@query(
    "b1_normalise_headers",
    'SELECT o_orderkey AS "order key", o_custkey AS "cust key" FROM orders',
)
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("  order \t  key "), F.col("o_custkey").alias("cust    key")
    )
    return settle(C.normalise_headers(raw))


@query(
    "b2_trim_strings",
    _DIRTY + r"SELECT o_orderkey, regexp_replace(priority, '^\s+|\s+$', '', 'g') AS priority FROM d",
)
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(C.trim_strings(dirty(spark, sf_dir).select("o_orderkey", "priority")))


@query(
    "b3_nullify_tokens",
    _DIRTY + "SELECT o_orderkey, CASE WHEN status IN ('None', 'null', 'N/A', 'NaN', '') THEN NULL ELSE status END"
    " AS status FROM d",
)
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(C.nullify_tokens(dirty(spark, sf_dir).select("o_orderkey", "status")))


@query("b4_project", _CURVES + f"SELECT id, {big('level')} AS level, q_gonality_bounds FROM curves")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = curves(spark, sf_dir)
    wanted = [c for c in ("id", "level", "absent") if c in have.columns]
    return settle(C.project(have, wanted, "q_gonality_bounds"))


@query(
    "b5_drop_null_rows",
    _TYPED + f"SELECT id, {r6('log_conductor')} AS log_conductor, {big('level')} AS level FROM t"
    " WHERE log_conductor IS NOT NULL AND level IS NOT NULL",
)
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select("id", "log_conductor", "level")
    return settle(C.drop_null_rows(rows, ["log_conductor", "absent"], "level"))


@query(
    "b6_coerce_numeric",
    _DIRTY + f"SELECT o_orderkey, {r6('coalesce(try_cast(trim(price) AS double), 0)')} AS price FROM d",
)
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(C.coerce_numeric(dirty(spark, sf_dir).select("o_orderkey", "price"), fill=0.0))


@query("b7_derive_rank", _CURVES + f"SELECT id, {big('genus - genus_minus_rank')} AS rank FROM curves")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(C.derive_rank(curves(spark, sf_dir)).select("id", "rank"))


@query(
    "b8_parse_list",
    _CURVES + "SELECT id, array_to_string(cast(canonical_conjugator AS int[]), ',') AS canonical_conjugator,"
    " coalesce(array_to_string(flatten(cast(conductor AS int[][])), ','), '') AS conductor,"
    f" {big('len(cast(conductor AS int[][]))')} AS pairs FROM curves",
)
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curves(spark, sf_dir).select("id", "canonical_conjugator", "conductor")
    parsed = C.parse_lists(rows, {"canonical_conjugator": 1, "conductor": 2})
    return settle(parsed.withColumn("pairs", F.size("conductor")))


@query(
    "b9_expand_list",
    _TYPED + "SELECT id, " + ", ".join(
        f"{big(f'canonical_conjugator[{i + 1}]')} AS canonical_conjugator_{i}" for i in range(4)
    ) + " FROM t",
)
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select("id", "canonical_conjugator")
    return settle(C.expand_list(rows, "canonical_conjugator").drop("canonical_conjugator"))


@query(
    "b10_split_exact_bounded",
    _TYPED + "SELECT lower = upper AS is_exact, count(*)::bigint AS n FROM t GROUP BY 1",
)
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.mark_exact(typed(spark, sf_dir).select("q_gonality_bounds"))
    return settle(rows.groupBy("is_exact").agg(F.count(F.lit(1)).alias("n")))


@query("b11_exact_target", _TYPED + f"SELECT id, {big('lower')} AS q_gonality FROM t WHERE lower = upper")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact_rows, _ = C.split_exact_bounded(typed(spark, sf_dir))
    return settle(C.exact_target(exact_rows).select("id", "q_gonality"))


@query(
    "b12_bounds_columns",
    _TYPED + f"SELECT id, {big('lower')} AS q_gonality_lower, {big('upper')} AS q_gonality_upper FROM t",
)
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.bounds_columns(curves(spark, sf_dir).select("id", "q_gonality_bounds"))
    return settle(rows.select("id", *C.bounds_targets(["q_gonality_bounds"])))


@query(
    "b13_to_float32",
    f"SELECT l_returnflag, {r6('sum((l_extendedprice::float)::double)')} AS price,"
    f" {r6('sum((l_discount::float)::double)')} AS discount FROM lineitem GROUP BY 1",
)
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.to_float32(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"])
    return settle(
        rows.groupBy("l_returnflag").agg(
            F.sum(F.col("l_extendedprice").cast("double")).alias("price"),
            F.sum(F.col("l_discount").cast("double")).alias("discount"),
        )
    )


@query(
    "b14_concat_rows",
    _TYPED + f"SELECT id, {big('lower')} AS q_gonality, NULL::bigint AS width FROM t WHERE lower = upper"
    f" UNION ALL BY NAME SELECT id, {big('upper - lower')} AS width, NULL::bigint AS q_gonality FROM t"
    " WHERE lower <> upper",
)
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact_rows, bounded = C.split_exact_bounded(typed(spark, sf_dir))
    width = bounded.select("id", (F.col("upper") - F.col("lower")).alias("width"))
    return settle(C.concat_rows([C.exact_target(exact_rows).select("id", "q_gonality"), width]))


@query(
    "b15_head_nulls",
    _TYPED + f"SELECT id, {r6('log_conductor')} AS log_conductor, {big('level')} AS level,"
    f" {big('canonical_conjugator[4]')} AS canonical_conjugator_3 FROM t"
    " WHERE log_conductor IS NULL OR level IS NULL OR canonical_conjugator[4] IS NULL ORDER BY id LIMIT 5",
)
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.expand_list(typed(spark, sf_dir), "canonical_conjugator")
    return settle(
        C.head_nulls(rows.select("id", "log_conductor", "level", "canonical_conjugator_3"), 5, ["id"])
    )
