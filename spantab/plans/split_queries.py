"""Queries over deduplication and the exact-size splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators import splits as S
from spantab.operators.cleaning import mark_exact
from spantab.plans.proxy import CATEGORICAL, NUMERICAL, TYPED_SQL, table, typed
from spantab.plans.registry import big, query, r6, settle
from spantab.staging import stage

DEDUP_KEY = ("level", "genus", "rank", "cusps", "canonical_conjugator", "level_is_squarefree")
FRAC = 1 / 9

_TYPED = f"WITH t AS ({TYPED_SQL}) "


def hash_sql(key: str, seed: str) -> str:
    return f"('0x' || substr(md5({seed} || ':' || {key}), 1, 8))::bigint"


# Distinct ids, the test set, and the five fresh splits of the rest.
SPLITS_SQL = f"""
ids AS (SELECT DISTINCT id FROM t),
h AS (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', "'42'")}, id) <= ceil((SELECT count(*) FROM ids)::double * 0.1)
      AS is_test FROM ids),
rest AS (SELECT id FROM h WHERE NOT is_test),
f AS (SELECT id, fold, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('id', "(42 + fold)::string")}, id)
      <= ceil((SELECT count(*) FROM rest)::double * {FRAC!r}::double) AS is_valid
      FROM rest CROSS JOIN (SELECT unnest(range(5)) AS fold) s),
m AS (SELECT id, fold, CASE WHEN is_valid THEN 'valid' ELSE 'train' END AS role FROM f
      UNION ALL SELECT id, fold, 'test' FROM h CROSS JOIN (SELECT unnest(range(5)) AS fold) s WHERE is_test)
"""


@query(
    "c1_dedup_first",
    _TYPED + ", r AS (SELECT *, row_number() OVER (PARTITION BY "
    + ", ".join(DEDUP_KEY)
    + f" ORDER BY id) AS rn FROM t) SELECT id, {big('level')} AS level, {big('genus')} AS genus,"
    f" {big('rank')} AS rank, {big('cusps')} AS cusps, array_to_string(canonical_conjugator, ',') AS"
    f" canonical_conjugator, level_is_squarefree, {r6('log_conductor')} AS log_conductor FROM r WHERE rn = 1",
)
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select("id", *DEDUP_KEY, "log_conductor")
    return settle(S.dedup_first(rows, DEDUP_KEY, "id"))


_ORDER_KEY = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query(
    "c1_first_by_number",
    f"SELECT {big('o_orderkey')} AS o_orderkey, {big('o_custkey')} AS o_custkey, o_orderstatus, o_orderpriority,"
    f" {r6('o_totalprice')} AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY {', '.join(_ORDER_KEY)}"
    " ORDER BY o_orderkey) = 1",
)
def c1_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *_ORDER_KEY, "o_totalprice")
    return settle(S.dedup_first_number(rows, _ORDER_KEY, "o_orderkey"))


@query("c2_holdout", _TYPED + "," + SPLITS_SQL + "SELECT id, is_test FROM h")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout(typed(spark, sf_dir).select("id"), "id").distinct()


@query("c3_repeated_splits", _TYPED + "," + SPLITS_SQL + "SELECT id, fold::bigint AS fold, role FROM m")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(S.repeated_splits(typed(spark, sf_dir), "id"))


@query(
    "c4_shift_split",
    _TYPED + f""", small AS (SELECT DISTINCT id FROM t WHERE level < 30),
v AS (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', "'42'")}, id)
      <= ceil((SELECT count(*) FROM small)::double * {FRAC!r}::double) AS is_valid FROM small),
r AS (SELECT t.id, CASE WHEN level >= 30 THEN 'test' WHEN v.is_valid THEN 'valid' ELSE 'train' END AS role, level
      FROM t LEFT JOIN v ON t.id = v.id)
SELECT role, count(*)::bigint AS n, min(level)::bigint AS lowest, max(level)::bigint AS highest,
       sum(level)::bigint AS total FROM r GROUP BY role""",
)
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.shift_split(typed(spark, sf_dir).select("id", "level"), "id", "level", 30)
    return settle(
        rows.groupBy("role").agg(
            F.count(F.lit(1)).alias("n"), F.min("level").alias("lowest"),
            F.max("level").alias("highest"), F.sum("level").alias("total"),
        )
    )


@query(
    "c5_split_summary",
    _TYPED + "," + SPLITS_SQL + "SELECT fold::bigint AS fold, role, count(*)::bigint AS n FROM m GROUP BY fold, role",
)
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(S.split_summary(S.repeated_splits(typed(spark, sf_dir), "id")))


@query(
    "c5_dedup_summary",
    _TYPED + ", g AS (SELECT lower = upper AS is_exact, count(*) AS n FROM t GROUP BY lower = upper, "
    + ", ".join(DEDUP_KEY)
    + ") SELECT is_exact, sum(n)::bigint AS rows_before, count(*)::bigint AS rows_after FROM g GROUP BY is_exact",
)
def c5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mark_exact(typed(spark, sf_dir))
    return settle(S.dedup_summary(rows, DEDUP_KEY, by=["is_exact"]))


def _weak_sql() -> str:
    """Roles of the distinct ids of each source, then its rows with their role."""
    parts = []
    for name, where in (("exact", "lower = upper"), ("bounded", "lower <> upper")):
        order = f"ORDER BY {hash_sql('id', repr('42'))}, id"
        parts.append(f"{name}_k AS (SELECT DISTINCT id FROM t WHERE {where})")
        parts.append(
            f"""{name}_h AS (SELECT id, row_number() OVER ({order})
            <= ceil((SELECT count(*) FROM {name}_k)::double * 0.1) AS is_test FROM {name}_k)"""
        )
        parts.append(
            f"""{name}_v AS (SELECT id, row_number() OVER ({order})
            <= ceil((SELECT count(*) FROM {name}_h WHERE NOT is_test)::double * {FRAC!r}::double) AS is_valid
            FROM {name}_h WHERE NOT is_test)"""
        )
        parts.append(
            f"""{name}_r AS (SELECT '{name}' AS source, lower, upper, CASE WHEN is_test THEN 'test'
            WHEN is_valid THEN 'valid' ELSE 'train' END AS role
            FROM (SELECT * FROM t WHERE {where}) s JOIN {name}_h ON s.id = {name}_h.id
            LEFT JOIN {name}_v ON s.id = {name}_v.id)"""
        )
    return ", ".join(parts)


@query(
    "c6_weak_sets",
    _TYPED + ", " + _weak_sql() + f""" SELECT role, source, count(*)::bigint AS n, {r6('avg(upper - lower)')} AS width,
    {big('sum(lower)')} AS lower_sum FROM (SELECT * FROM exact_r UNION ALL SELECT * FROM bounded_r) u
    GROUP BY role, source""",
)
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The list text is parsed once; every later pass reads typed columns.
    rows = stage(typed(spark, sf_dir).select("id", "lower", "upper", "q_gonality_bounds"), "weak")
    exact_rows, bounded = rows.filter("lower = upper"), rows.filter("lower <> upper")
    plans = [S.fit_splits(part, "id", n=1) for part in (exact_rows, bounded)]
    sets = S.weak_sets(exact_rows, bounded, *plans)
    return settle(
        sets.groupBy("role", "source").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("q_gonality_upper") - F.col("q_gonality_lower")).alias("width"),
            F.sum("q_gonality_lower").alias("lower_sum"),
        )
    )
