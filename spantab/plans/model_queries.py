"""Queries over formulas, least squares, boosting, trees and small networks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.functions.formula import formula_columns
from spantab.operators import boosting as B
from spantab.operators import linear as L
from spantab.operators import mlp as N
from spantab.operators.boost_state import durable_boost
from spantab.operators.boosted_trees import TreeSettings, tree_folds
from spantab.operators.candidates import parse_candidates
from spantab.operators.cleaning import expand_list, is_exact
from spantab.operators.features import apply_scaler, exponents, fit_scaler
from spantab.operators.folds import linear_folds
from spantab.operators.metrics import fold_average, metrics
from spantab.operators.minibatch import PRIME, BatchFit, epoch_factors, fit_minibatches
from spantab.operators.runlog import best_epoch, new_best_flags, ordered_log
from spantab.operators.splits import fit_splits
from spantab.operators.trees import gbt_fit, gbt_predict
from spantab.plans.proxy import (
    FIXED_COEF,
    FIXED_INTERCEPT,
    FIXED_P_SQL,
    NUMERICAL,
    TYPED_SQL,
    exact,
    table,
    typed,
)
from spantab.plans.registry import big, query, r6, settle
from spantab.plans.split_queries import SPLITS_SQL
from spantab.staging import stage, staged, staging_path

_TYPED = f"WITH t AS ({TYPED_SQL}) "
_EXACT = f"WITH t AS (SELECT *, lower AS y FROM ({TYPED_SQL}) a WHERE lower = upper) "


@query(
    "e1_gram",
    _EXACT + ", s AS (SELECT level::double AS level, genus::double AS genus, y::double AS y FROM t)"
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'sum({x} * {z})')} AS value FROM s"
        for a, b, x, z in [
            ("1", "1", "1", "1"), ("1", "level", "1", "level"), ("1", "genus", "1", "genus"), ("1", "y", "1", "y"),
            ("level", "level", "level", "level"), ("level", "genus", "level", "genus"), ("level", "y", "level", "y"),
            ("genus", "genus", "genus", "genus"), ("genus", "y", "genus", "y"), ("y", "y", "y", "y"),
        ]
    ),
)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(L.gram(exact(spark, sf_dir), ["level", "genus", "y"]))


@query(
    "e2_ols_fit",
    _EXACT + f"SELECT 'level' AS name, {r6('regr_slope(y, level)')} AS value FROM t"
    f" UNION ALL SELECT 'intercept', {r6('regr_intercept(y, level)')} FROM t",
)
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = L.ols_fit(exact(spark, sf_dir), ["level"], "y")
    rows = [*zip(model.names, map(float, model.coef)), ("intercept", model.intercept)]
    return settle(spark.createDataFrame(rows, "name string, value double"))


#: Two columns that agree to about five digits.
CLOSE = 1e-4


@query(
    "e2_near_collinear",
    _EXACT + ", c AS (SELECT covar_pop(level, genus) AS lg, var_pop(level) AS ll, var_pop(genus) AS gg,"
    " covar_pop(level, y) AS ly, covar_pop(genus, y) AS gy, avg(level) AS l, avg(genus) AS g, avg(y) AS m FROM t),"
    " b AS (SELECT *, (ly * gg - gy * lg) / (ll * gg - lg * lg) AS bl, (gy * ll - ly * lg) / (ll * gg - lg * lg) AS bg FROM c)"
    f" SELECT 'both' AS name, {r6('bl')} AS value FROM b UNION ALL SELECT 'between', {r6('bg')} FROM b"
    f" UNION ALL SELECT 'intercept', {r6('m - bl * l - bg * g')} FROM b",
)
def e2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of level and of level plus a trace of genus, stated as those of level and genus."""
    rows = exact(spark, sf_dir).select("y", "level", (F.col("level") + F.lit(CLOSE) * F.col("genus")).alias("near"))
    model = L.ols_fit(rows, ["level", "near"], "y")
    level, near = map(float, model.coef)
    values = [("both", level + near), ("between", CLOSE * near), ("intercept", model.intercept)]
    return settle(spark.createDataFrame(values, "name string, value double"))


def _fixed_linear() -> L.LinearModel:
    names = (*FIXED_COEF, "log_conductor")
    return L.LinearModel(names, np.array([*FIXED_COEF.values(), 0.25]), FIXED_INTERCEPT)


@query(
    "e3_ols_predict",
    _TYPED + f"SELECT id, {r6(f'{FIXED_P_SQL} + 0.25::double * coalesce(log_conductor, 0)')} AS p FROM t",
)
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(L.ols_predict(typed(spark, sf_dir), _fixed_linear()).select("id", "p"))


def _guard(sql: str) -> str:
    """The finished formula: anything that is no finite number is 0."""
    return f"CASE WHEN isfinite(({sql})::double) THEN ({sql})::double ELSE 0 END"


# Formula bodies with the same value spelled in SQL.
FORMULAS = {
    "share": ("row['cusps'] / (row['genus'] + 1) if row['genus'] > 3 else row['cusps']",
              "CASE WHEN genus > 3 THEN cusps::double / (genus + 1) ELSE cusps END"),
    "logs": ("log(row['level']) * sqrt(row['rank'] + 1) - row['cusps'] ** 2",
             "ln(greatest(level, 1e-10::double)) * sqrt(greatest(rank + 1, 0)) - cusps::double * cusps"),
    "pole": ("1 / row['rational_cusps']", "1.0::double / nullif(rational_cusps, 0)"),
    "growth": ("exp(row['genus'] / 10) - np.log1p(row['cusps'])", "exp(genus / 10.0::double) - ln(1.0::double + cusps)"),
    "spread": ("max(row['genus'], row['rank'], 3) % 4 + min(row['level'], 20)",
               "greatest(genus, rank, 3) % 4 + least(level, 20)"),
    "missing": ("row['log_conductor'] * 2", "coalesce(log_conductor * 2, 0)"),
    "root": ("(row['genus'] - 4) ** 0.5", "CASE WHEN genus >= 4 THEN sqrt(genus - 4::double) ELSE 0 END"),
    "strict": ("math.log(row['rational_cusps']) + 1",
               "CASE WHEN rational_cusps > 0 THEN ln(nullif(rational_cusps, 0)::double) + 1 ELSE 0 END"),
    "absent": ("row['no_such_column'] + 1", "0"),
    "logic": ("1 < row['genus'] <= 4 and not row['rank']", "(1 < genus AND genus <= 4 AND rank = 0)::int"),
}


@query(
    "e4_formula",
    _TYPED + "SELECT id, " + ", ".join(
        f"{r6(f'coalesce({_guard(sql)}, 0)')} AS {name}" for name, (_, sql) in FORMULAS.items()
    ) + " FROM t",
)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formula_columns(typed(spark, sf_dir), {n: body for n, (body, _) in FORMULAS.items()})
    return settle(rows.select("id", *FORMULAS))


_CHECKED = ("level", "log_conductor", "canonical_conjugator_3")


def _checked_sql(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}::double) FROM u))"
    ratio = f"count({c})::double / count(*)"
    partial = f"({ratio}) >= 0.95 AND ({ratio}) < 1"
    variance = f"CASE WHEN {partial} THEN var_samp({filled}) ELSE var_samp({c}) END"
    return (
        f"SELECT '{c}' AS \"column\", {r6(ratio)} AS valid_ratio, {r6(variance)} AS variance,"
        f" {r6(f'CASE WHEN {partial} THEN median({c}::double) END')} AS fill,"
        f" ({ratio}) >= 0.95 AND ({variance}) >= 1e-15 AS accepted FROM u"
    )


@query(
    "e5_validate_features",
    _TYPED + ", u AS (SELECT *, canonical_conjugator[4] AS canonical_conjugator_3 FROM t) "
    + " UNION ALL ".join(_checked_sql(c) for c in _CHECKED),
)
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand_list(typed(spark, sf_dir), "canonical_conjugator")
    return settle(B.validate_features(rows, _CHECKED))


_ONE_BASE = """, b AS (SELECT regr_slope(y, genus) AS s, regr_intercept(y, genus) AS i FROM t),
r AS (SELECT genus, y, level::double AS z, s * genus + i AS p, y - (s * genus + i) AS r FROM t, b),
q AS (SELECT regr_slope(z, genus) AS zs, regr_intercept(z, genus) AS zi, avg(r) AS mr FROM r),
e AS (SELECT y, p, r, z - zs * genus - zi AS e, zs, zi, mr FROM r, q),
f AS (SELECT covar_pop(e, r) / var_pop(e) AS slope, any_value(mr) AS intercept, any_value(zs) AS zs,
      any_value(zi) AS zi FROM e) """


@query(
    "e6_score_candidates",
    _EXACT + _ONE_BASE + f"""SELECT 1::bigint AS seq, 'level' AS name, {r6('any_value(f.slope)')} AS slope,
    {r6('any_value(f.intercept)')} AS intercept, {r6('any_value(f.zs)')} AS predictor,
    {r6('any_value(f.zi)')} AS predictor_intercept,
    {r6('avg((floor(p + f.slope * e + f.intercept + 0.5) = y)::int) * 100')} AS accuracy FROM e, f""",
)
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact(spark, sf_dir)
    model = B.fit_initial(rows, ["genus"], "y", degree=1)
    batch = spark.createDataFrame([(1, "level", "row['level']")], "seq bigint, name string, body string")
    scores = B.score_candidates(rows, model, batch, "y")
    return settle(
        scores.select(
            "seq", "name", "slope", "intercept", F.get("predictor", 0).alias("predictor"), "predictor_intercept",
            "accuracy",
        )
    )


#: Candidates of the cubic query: name, formula, the same in SQL. The last one is a monomial of the base.
CUBIC_CANDIDATES = (
    ("sevenths", "row['level'] // 7", "floor(level / 7.0::double)"),
    ("logs", "log(row['level'])", "ln(level::double)"),
    ("ratio", "row['cusps'] / (row['genus'] + 1)", "cusps::double / (genus + 1)"),
    ("fours", "row['level'] % 4 + row['genus'] // 2", "level % 4 + floor(genus / 2.0::double)"),
    ("roots", "sqrt(row['coarse_class_num'] + 1)", "sqrt(coarse_class_num + 1.0::double)"),
    ("half", "max(row['genus'], 4) * min(row['level'], 20)", "(greatest(genus, 4) * least(level, 20))::double"),
    ("spanned", "row['level'] * row['genus']", "(level * genus)::double"),
)


def _cubic_sql() -> str:
    """Rows ``w`` of the exact rows with target y, cubic prediction p and each candidate's rest e0, e1, ...

    Normal equations of the monomials of standardised base columns, solved by Gauss-Jordan steps over (i, j, v).
    """
    powers = [(0,) * len(NUMERICAL), *exponents(len(NUMERICAL), 3)]
    n, m = len(powers), len(CUBIC_CANDIDATES)
    base = [f"coalesce({c}::double, 0)" for c in NUMERICAL]
    standard = ", ".join(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS u{i}" for i, x in enumerate(base))
    made = ", ".join(f"{sql} AS z{j}" for j, (_, _, sql) in enumerate(CUBIC_CANDIDATES))
    monomial = ", ".join(" * ".join(["1.0::double", *(f"u{i}" for i, e in enumerate(p) for _ in range(e))]) for p in powers)
    columns = [*(f"x[{i + 1}]" for i in range(n)), *(f"z{j}" for j in range(m)), "y"]
    sums = ", ".join(f"sum({columns[i]} * {columns[j]})" for i in range(n) for j in range(len(columns)))
    width = len(columns)
    dots = ", ".join(
        [f"list_dot_product(x, (SELECT b FROM c WHERE j = {n + m})) AS p"]
        + [f"z{j} - list_dot_product(x, (SELECT b FROM c WHERE j = {n + j})) AS e{j}" for j in range(m)]
    )
    return (
        f", u AS (SELECT y::double AS y, {standard}, {made} FROM t),"
        f" x AS MATERIALIZED (SELECT *, [{monomial}] AS x FROM u),"
        f" s AS MATERIALIZED (SELECT unnest([{sums}]) AS v, unnest(range({n * width})) AS k FROM x),"
        f" g AS (WITH RECURSIVE r(step, i, j, v) AS (SELECT 0, k // {width}, k % {width}, v FROM s UNION ALL"
        " SELECT a.step + 1, a.i, a.j, CASE WHEN a.i = a.step THEN a.v / p.v ELSE a.v - c.v * b.v / p.v END"
        " FROM r a JOIN r p ON p.i = a.step AND p.j = a.step JOIN r b ON b.i = a.step AND b.j = a.j"
        f" JOIN r c ON c.j = a.step AND c.i = a.i WHERE a.step < {n}) SELECT i, j, v FROM r WHERE step = {n} AND j >= {n}),"
        " c AS (SELECT j, list(v ORDER BY i) AS b FROM g GROUP BY j),"
        f" w AS MATERIALIZED (SELECT y, {dots}, {', '.join(f'z{j}' for j in range(m))} FROM x) "
    )


@query(
    "e6_score_cubic",
    _EXACT + _cubic_sql() + " UNION ALL ".join(
        f"SELECT {j}::bigint AS seq, '{name}' AS name, {r6('slope')} AS slope,"
        f" {r6(f'avg((floor(p + slope * e{j} + centre + 0.5) = y)::int) * 100')} AS accuracy"
        f" FROM w, (SELECT sum(e{j} * (y - p)) / sum(e{j} * e{j}) AS slope, avg(y - p) AS centre FROM w) GROUP BY slope"
        for j, (name, _, _) in enumerate(CUBIC_CANDIDATES) if name != "spanned"
    ),
)
def e6_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on the cubic design of all base columns; one that the design spans gets no score."""
    rows = exact(spark, sf_dir)
    model = B.fit_initial(rows, list(NUMERICAL), "y", degree=3)
    listed = [(j, name, body) for j, (name, body, _) in enumerate(CUBIC_CANDIDATES)]
    batch = spark.createDataFrame(listed, "seq bigint, name string, body string")
    return settle(B.score_candidates(rows, model, batch, "y").select("seq", "name", "slope", "accuracy"))


@query(
    "e7_select_candidate",
    f"SELECT p_partkey AS seq, p_name AS name, {r6('p_size')} AS accuracy FROM part WHERE p_size >= 20 + 0.01"
    " ORDER BY p_size DESC, p_partkey LIMIT 1",
)
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("accuracy")
    )
    return settle(B.select_candidate(scores, 20.0))


def fixed_boost() -> B.BoostModel:
    """Two base columns and two stages with fixed coefficients."""
    stages = (
        B.Stage("ratio", "row['cusps'] / (row['genus'] + 1)", 0.3, 0.05, (0.2, -0.1), 0.4),
        B.Stage("logs", "log(row['level'])", -0.6, 0.02, (0.01, 0.03, 0.5), -0.25),
    )
    return B.BoostModel(("genus", "level"), 1, (0.5, 0.1), 0.6, stages)


_FIXED_BOOST_SQL = (
    "0.5::double * genus + 0.1::double * level + 0.6::double"
    " + 0.3::double * (ratio - (0.2::double * genus - 0.1::double * level + 0.4::double)) + 0.05::double"
    " - 0.6::double * (logs - (0.01::double * genus + 0.03::double * level + 0.5::double * ratio - 0.25::double))"
    " + 0.02::double"
)


@query(
    "e8_boosted_predict",
    _TYPED + ", f AS (SELECT id, genus, level, cusps::double / (genus + 1) AS ratio,"
    f" ln(greatest(level, 1e-10::double)) AS logs FROM t) SELECT id, {r6(_FIXED_BOOST_SQL)} AS p FROM f",
)
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(B.boosted_predict(typed(spark, sf_dir), fixed_boost()).select("id", "p"))


@query(
    "e9_coefficients",
    _EXACT + f"SELECT 0::bigint AS position, 'poly_genus' AS name, {r6('regr_slope(y, genus)')} AS value FROM t"
    f" UNION ALL SELECT 1, 'poly_intercept', {r6('regr_intercept(y, genus)')} FROM t",
)
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = B.fit_initial(exact(spark, sf_dir), ["genus"], "y", degree=1)
    return settle(B.coefficients(model, spark))


@query("e9_coefficients_cubic")
def e9_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(B.coefficients(B.fit_initial(exact(spark, sf_dir), list(NUMERICAL), "y", degree=3), spark))


@query(
    "e9_cubic_fit",
    _EXACT + _cubic_sql() + f"SELECT count(*)::bigint AS n, {r6('avg((y - p) * (y - p))')} AS error,"
    f" {r6('avg((floor(p + 0.5) = y)::int) * 100')} AS accuracy, 0::bigint AS slanted FROM w",
)
def e9_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of the cubic fit, and the number of design columns that its residual still leans on."""
    rows = stage(exact(spark, sf_dir).select("y", *NUMERICAL), "cubic-rows")
    model = B.fit_initial(rows, list(NUMERICAL), "y", degree=3)
    scored = B.boosted_predict(rows, model).withColumn("r", F.col("y") - F.col("p"))
    slanted = int((np.abs(L.design_correlations(scored, model.design, F.col("r"))) > 1e-6).sum())
    found = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("r") * F.col("r")).alias("error"),
        (F.avg((F.floor(F.col("p") + 0.5) == F.col("y")).cast("double")) * 100).alias("accuracy"),
        F.lit(slanted).alias("slanted"),
    )
    return settle(found)


def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses spelled from part rows, parsed into a candidates table."""
    kinds = F.array(
        F.lit("floor_of_level(row['level'] // X)"), F.lit("row['level'] // X"), F.lit("row['genus'] // 2 + log(row['level'] + X)"),
        F.lit("row['cusps'] / (row['genus'] + X)"), F.lit("sqrt(row['level'] * X) if row['genus'] > 2 else row['cusps']"),
    )
    body = F.replace(F.get(kinds, (F.col("p_partkey") % 5).cast("int")), F.lit("X"), F.col("p_size").cast("string"))
    text = F.concat(F.lit("def f1(row): return "), body, F.lit("\nReason: "), F.col("p_name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), text.alias("text"))
    parsed = parse_candidates(parts)
    return parsed.select("seq", "code_str", F.col("readable").alias("name"), "body", "reason")


#: Declared parameters of the boosting query: all base features as they are, and the usual number of rounds.
BOOST_DEGREE, BOOST_ROUNDS = 1, 20


@query("e10_boost_loop")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact(spark, sf_dir)
    run = B.start_run(rows, list(NUMERICAL), "y", degree=BOOST_DEGREE)
    run = B.boost_loop(rows, candidate_table(spark, sf_dir), "y", run, rounds=BOOST_ROUNDS)
    progress = [(i + 1, float(a)) for i, a in enumerate(run.accuracies)]
    return settle(spark.createDataFrame(progress, "iteration bigint, boosting_accuracy double"))


#: Declared parameters of the resumed run: one base column, one candidate a round, stopped after half of the rounds.
SEQUENCE_ROUNDS, SEQUENCE_STOP = 16, 9


def _sequence_sql() -> str:
    """CTE ``g`` (place, accuracy): the base model and every scored round, one candidate after the other.

    ``e`` columns are the accepted candidates' rests, orthogonal to the design before them.
    """
    z = (
        "CASE kind WHEN 1 THEN floor(level / x) WHEN 2 THEN floor(genus / 2.0::double) + ln(level + x)"
        " WHEN 3 THEN cusps::double / (genus + x) WHEN 4 THEN CASE WHEN genus > 2 THEN sqrt(level * x) ELSE cusps END END"
    )
    parts = [
        "k AS (SELECT *, row_number() OVER (PARTITION BY kind, x ORDER BY p_partkey) = 1 AS is_new FROM (SELECT p_partkey,"
        " p_partkey % 5 AS kind, p_size::double AS x FROM part ORDER BY p_partkey LIMIT " + str(SEQUENCE_ROUNDS) + ")),"
        " c AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i, sum(is_new::int) OVER (ORDER BY p_partkey) AS drawn FROM k)",
        "b AS (SELECT regr_slope(y, genus) AS s, regr_intercept(y, genus) AS i, avg(genus) AS g FROM t)",
        "r0 AS MATERIALIZED (SELECT level, genus, cusps, y, genus - g AS d, s * genus + b.i AS p FROM t, b)",
        "a0 AS (SELECT avg((floor(p + 0.5) = y)::int) * 100 AS best FROM r0)",
    ]
    kept, shown = [], ["SELECT 0 AS place, best AS accuracy FROM a0"]
    for i in range(1, SEQUENCE_ROUNDS + 1):
        columns = "".join(f", {e}" for e in kept)
        rest = "z - m - d * zd / nullif(dd, 0)" + "".join(f" - coalesce({e} * z{e} / nullif(n{e}, 0), 0)" for e in kept)
        sums = "".join(f", sum(z * {e}) AS z{e}, sum({e} * {e}) AS n{e}" for e in kept)
        parts += [
            f"v{i} AS MATERIALIZED (SELECT level, genus, cusps, y, d, p{columns}, {z} AS z FROM r{i - 1},"
            f" (SELECT * FROM c WHERE i = {i}))",
            f"m{i} AS (SELECT avg(z) AS m, sum(z * d) AS zd, sum(d * d) AS dd, var_pop(z) * count(*) AS zz{sums} FROM v{i})",
            f"e{i}q AS MATERIALIZED (SELECT v{i}.*, {rest} AS e FROM v{i}, m{i})",
            f"f{i} AS (SELECT sum(e * (y - p)) / nullif(sum(e * e), 0) AS slope, avg(y - p) AS centre,"
            f" sum(e * e) >= 1e-10 * any_value(zz) AND sum(e * e) / count(*) >= 1e-15 AS usable FROM e{i}q, m{i})",
            f"h{i} AS (SELECT *, is_new AND drawn >= 5 AS scored, is_new AND drawn >= 5 AND coalesce(usable, false)"
            f" AND accuracy >= best + 0.01 AS taken FROM (SELECT slope, centre, usable,"
            f" avg((floor(p + slope * e + centre + 0.5) = y)::int) * 100 AS accuracy FROM e{i}q, f{i} GROUP BY ALL),"
            f" (SELECT is_new, drawn FROM c WHERE i = {i}), a{i - 1})",
            f"a{i} AS (SELECT CASE WHEN taken THEN accuracy ELSE best END AS best FROM h{i})",
            f"r{i} AS MATERIALIZED (SELECT level, genus, cusps, y, d, CASE WHEN taken THEN p + slope * e + centre ELSE p END AS p"
            f"{columns}, CASE WHEN taken THEN e ELSE 0 END AS x{i} FROM e{i}q, h{i})",
        ]
        kept.append(f"x{i}")
        shown.append(f"SELECT {i}, best FROM a{i} WHERE (SELECT scored FROM h{i})")
    return ", " + ", ".join([*parts, f"g AS ({' UNION ALL '.join(shown)}) "])


@query(
    "e10_resumed_sequence",
    _EXACT + _sequence_sql() + f"SELECT {big('row_number() OVER (ORDER BY place)')} AS iteration,"
    f" {r6('accuracy')} AS boosting_accuracy, true AS same_as_uninterrupted FROM g",
)
def e10_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of a run that was stopped half way and taken up again, beside those of one that was not."""
    candidates = candidate_table(spark, sf_dir)
    folder = staging_path(spark, "rounds")
    options = {"degree": 1, "tries": 1}
    with staged(exact(spark, sf_dir).select("y", *NUMERICAL), "exact") as rows:
        durable_boost(rows, candidates, ["genus"], "y", folder, SEQUENCE_STOP, **options)
        resumed = durable_boost(rows, candidates, ["genus"], "y", folder, SEQUENCE_ROUNDS, **options)
        whole = B.boost_loop(rows, candidates, "y", B.start_run(rows, ["genus"], "y", 1), SEQUENCE_ROUNDS, tries=1)
    same = len(whole.accuracies) == len(resumed.accuracies) and [s.body for s in whole.model.stages] == [
        s.body for s in resumed.model.stages
    ]
    progress = [
        (i + 1, float(a), same and abs(a - b) < 1e-9) for i, (a, b) in enumerate(zip(resumed.accuracies, whole.accuracies))
    ]
    return settle(
        spark.createDataFrame(progress, "iteration bigint, boosting_accuracy double, same_as_uninterrupted boolean")
    )


@query("e11_state_round_trip", _EXACT + f"SELECT count(*)::bigint AS n, {r6('0')} AS largest_change FROM t")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact(spark, sf_dir)
    run = B.start_run(rows, ["level", "genus"], "y", degree=2)
    run.model = B.replace(fixed_boost(), current_accuracy=1.0)
    path = staging_path(spark, "state")
    B.save_state(run, spark, path)
    loaded = B.load_state(spark, path, restore_best=False)
    both = B.boosted_predict(B.boosted_predict(rows, run.model, "before"), loaded.model, "after")
    return settle(
        both.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_change")
        )
    )


#: Declared parameters of the boosted trees.
TREES = {"maxDepth": 4, "maxIter": 5, "stepSize": 0.3}


@query("e12_gbt")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact(spark, sf_dir)
    plan = fit_splits(rows, "id", n=1)
    roles = plan.with_role(rows, 0)
    model = gbt_fit(roles.filter("role = 'train'"), NUMERICAL, "y", **TREES)
    return settle(metrics(gbt_predict(roles, model), by=["role"]))


def _elimination_sql(features: tuple[str, ...]) -> str:
    """CTEs from ``x0`` to predictions ``p``: least squares per fold by one column after the other.

    Each step takes the projection on a column out of the target and of the later columns.
    """
    n = len(features)

    def train(expression: str) -> str:
        return f"({expression}) FILTER (role = 'train') OVER (PARTITION BY fold)"

    kept = "fold, role, lower, upper, y"
    centred = ", ".join(f"x{i} - avg{train(f'x{i}')} AS x{i}" for i in range(n))
    steps = [f"z0 AS (SELECT {kept}, {centred}, avg{train('y')} AS p, y - avg{train('y')} AS e FROM x0)"]
    for i in range(n):
        own = f"sum{train(f'x{i} * x{i}')}"
        share = f"x{i} * sum{train(f'x{i} * e')} / {own}"
        later = "".join(f", x{j} - x{i} * sum{train(f'x{i} * x{j}')} / {own} AS x{j}" for j in range(i + 1, n))
        steps.append(f"z{i + 1} AS MATERIALIZED (SELECT {kept}, p + {share} AS p, e - {share} AS e{later} FROM z{i})")
    return ", ".join(steps)


#: Rows of every fold with their role: exact ones by the splits, bounded ones in each.
_FOLD_ROWS_SQL = (
    f"WITH a AS ({TYPED_SQL}), t AS (SELECT *, lower AS y FROM a WHERE lower = upper)," + SPLITS_SQL
    + ", r AS (SELECT fold, role, t.* FROM t JOIN m ON t.id = m.id UNION ALL"
    " SELECT fold, 'bounded', a.*, NULL FROM a CROSS JOIN (SELECT unnest(range(5)) AS fold) s WHERE lower <> upper), "
)
_FOLD_VALUES_SQL = (
    ", v AS (SELECT fold, role AS set, CASE WHEN role <> 'bounded' THEN"
    " 1 - sum((y - g) * (y - g)) / (var_pop(y) * count(y)) END AS r2,"
    " CASE WHEN role <> 'bounded' THEN avg((g = y)::int) END AS accuracy,"
    " CASE WHEN role <> 'bounded' THEN sqrt(avg((y - g) * (y - g))) END AS rmse,"
    " CASE WHEN role = 'bounded' THEN avg((g BETWEEN lower AND upper)::int) END AS bounds_accuracy"
    " FROM g GROUP BY fold, role) "
)
_LINEAR_SQL = (
    "x0 AS (SELECT fold, role, lower, upper, y::double AS y, "
    + ", ".join(f"coalesce({c}::double, 0) AS x{i}" for i, c in enumerate(NUMERICAL)) + " FROM r), "
    + _elimination_sql(NUMERICAL) + f", g AS (SELECT *, floor(p + 0.5) AS g FROM z{len(NUMERICAL)})"
)
_MEASURES = ("r2", "accuracy", "rmse", "bounds_accuracy")


def _fold_measures_sql(predictions: str) -> str:
    """Measures per fold and set of rows ``g`` with a rounded prediction."""
    measures = ", ".join(f"{r6(c)} AS {c}" for c in _MEASURES)
    return f"{_FOLD_ROWS_SQL}{predictions}{_FOLD_VALUES_SQL}SELECT fold::bigint AS fold, set, {measures} FROM v"


@contextmanager
def _parsed(spark: SparkSession, sf_dir: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Exact rows with target and bounded rows, parsed once for all passes over them."""
    columns = ["id", *NUMERICAL, "lower", "upper"]
    with staged(typed(spark, sf_dir).select(*columns, is_exact().alias("exact")), "parsed") as rows:
        yield rows.filter("exact").select(*columns, F.col("lower").alias("y")), rows.filter("NOT exact").select(*columns)


def _all_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _parsed(spark, sf_dir) as (exact_rows, bounded):
        plan = fit_splits(exact_rows, "id", n=5)
        return linear_folds(exact_rows, bounded, plan, NUMERICAL)


@query("e13_fold_experiment", _fold_measures_sql(_LINEAR_SQL))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(_all_folds(spark, sf_dir))


@query(
    "e13_fold_average",
    _FOLD_ROWS_SQL + _LINEAR_SQL + _FOLD_VALUES_SQL + "SELECT set, " + ", ".join(f"{r6(f'avg({c})')} AS {c}" for c in _MEASURES) + " FROM v GROUP BY set",
)
def e13_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(fold_average(_all_folds(spark, sf_dir)))


#: Declared parameters of the histogram trees.
STUMPS = TreeSettings(trees=4, depth=1, rate=0.3, bins=32)
PAIRS = TreeSettings(trees=3, depth=2, rate=0.3, bins=32)


def _trees_sql(settings: TreeSettings) -> str:
    """Rows ``g`` with the rounded predictions of boosted trees, level by level."""
    n, bins = len(NUMERICAL), settings.bins
    own = [f"coalesce({c}::double, 0)" for c in NUMERICAL]
    first = f"(k * {bins} + n - 1) // n"
    cuts = ", ".join(
        f"c{i} AS (SELECT list_sort(list(DISTINCT v) FILTER (v > low)) AS c FROM (SELECT {x} AS v,"
        f" row_number() OVER (ORDER BY {x}) - 1 AS k, count(*) OVER () AS n, min({x}) OVER () AS low FROM t)"
        f" WHERE {first} < {bins} AND {first} * n // {bins} = k)" for i, x in enumerate(own)
    )
    binned = ", ".join(f"len(list_filter((SELECT c FROM c{i}), lambda v: v <= {x}))" for i, x in enumerate(own))
    start = "avg(y) FILTER (role = 'train') OVER (PARTITION BY fold)"
    parts = [cuts, f"z AS MATERIALIZED (SELECT id, fold, role, lower, upper, y, [{binned}] AS b, {start} AS p FROM r)"]
    rows = "z"
    for k in range(settings.trees):
        drawn = ", ".join(str(i) for i in settings.columns(NUMERICAL, k))
        sampled = f"role = 'train' AND substr(md5('{settings.row_seed(k)}:' || id), 1, 8) < '{settings.row_limit()}'"
        state, extra = rows, "0 AS node, 0.0::double AS w"
        for level in range(settings.depth + 1):
            at, open_ = f"{k}_{level}", 2**level - 1
            parts.append(f"q{at} AS MATERIALIZED (SELECT *, {extra} FROM {state})")
            at_level = f"q{at} WHERE {sampled} AND node >= {open_}"
            if level == settings.depth:
                parts.append(f"s{at} AS (SELECT fold, node, sum(p - y) AS g, count(*) AS h, NULL AS f, NULL AS cut"
                             f" FROM {at_level} GROUP BY fold, node)")
            else:
                score = "({g}) * ({g}) / ({h} + " + f"{settings.penalty}::double)"
                gain = " + ".join([score.format(g="gl", h="hl"), score.format(g="g - gl", h="h - hl")])
                least = settings.min_curvature
                parts += [
                    f"h{at} AS (SELECT fold, node, f, b[f + 1] AS bin, sum(p - y) AS g, count(*) AS h FROM"
                    f" (SELECT *, unnest([{drawn}]) AS f FROM {at_level}) GROUP BY ALL)",
                    f"l{at} AS (SELECT fold, node, f, bin, coalesce(sum(g) OVER e, 0) AS gl, coalesce(sum(h) OVER e, 0) AS hl,"
                    f" sum(g) OVER a AS g, sum(h) OVER a AS h FROM h{at} WINDOW a AS (PARTITION BY fold, node, f),"
                    " e AS (PARTITION BY fold, node, f ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
                    f"n{at} AS (SELECT *, CASE WHEN hl >= {least} AND h - hl >= {least} AND gain > {settings.min_gain}"
                    f" THEN gain END AS kept FROM (SELECT *, round(({gain} - {score.format(g='g', h='h')}) / 2, 6) AS gain"
                    f" FROM l{at}))",
                    f"s{at} AS (SELECT fold, node, g, h, CASE WHEN kept IS NOT NULL THEN f END AS f,"
                    f" CASE WHEN kept IS NOT NULL THEN bin END AS cut FROM n{at} QUALIFY row_number() OVER"
                    " (PARTITION BY fold, node ORDER BY kept DESC NULLS LAST, f, bin) = 1)",
                ]
            leaf = f"-s.g / (s.h + {settings.penalty}::double)"
            state = (
                f"(SELECT q.* REPLACE (CASE WHEN s.f IS NOT NULL THEN 2 * q.node + 1 + (q.b[s.f + 1] >= s.cut)::int"
                f" ELSE q.node END AS node, CASE WHEN s.f IS NOT NULL THEN 0 WHEN s.h IS NOT NULL THEN {leaf} ELSE w END AS w)"
                f" FROM q{at} q LEFT JOIN s{at} s ON q.fold = s.fold AND q.node = s.node)"
            )
            extra = "1 AS _"
            state = state.replace("q.* REPLACE", "q.* EXCLUDE (_) REPLACE") if level else state
        parts.append(f"z{k} AS MATERIALIZED (SELECT id, fold, role, lower, upper, y, b, p + {settings.rate}::double * w AS p"
                     f" FROM {state})")
        rows = f"z{k}"
    return ", ".join([*parts, f"g AS (SELECT *, floor(p + 0.5) AS g FROM {rows})"])


def _tree_folds(spark: SparkSession, sf_dir: str, settings: TreeSettings) -> DataFrame:
    with _parsed(spark, sf_dir) as (exact_rows, bounded):
        plan = fit_splits(exact_rows, "id", n=5)
        return settle(tree_folds(exact_rows, bounded, plan, NUMERICAL, settings))


@query("e12_histogram_stumps", _fold_measures_sql(_trees_sql(STUMPS)))
def e12_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_folds(spark, sf_dir, STUMPS)


@query("e12_histogram_trees", _fold_measures_sql(_trees_sql(PAIRS)))
def e12_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_folds(spark, sf_dir, PAIRS)


_WEIGHTS = N.Network((2, 2, 1), np.array([0.5, -0.25, 0.1, 0.2, 0.3, -0.4, 0.7, -0.6, 0.05]), 0.01)


def _leaky(sql: str) -> str:
    return f"CASE WHEN {sql} > 0 THEN {sql} ELSE 0.01::double * ({sql}) END"


@query(
    "e15_mlp_predict",
    _TYPED + f""", h AS (SELECT id, {_leaky('(0.5::double * genus - 0.25::double * cusps + 0.3::double)')} AS a,
    {_leaky('(0.1::double * genus + 0.2::double * cusps - 0.4::double)')} AS b FROM t)
    SELECT id, {r6(_leaky('(0.7::double * a - 0.6::double * b + 0.05::double)'))} AS p FROM h""",
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(N.mlp_predict(typed(spark, sf_dir), _WEIGHTS, ["genus", "cusps"]).select("id", "p"))


#: Declared parameters of the network queries: hidden layers and epochs; every feature and row takes part.
HIDDEN, EPOCHS, WARM_EPOCHS = (16, 8), 5, 3


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).select(*NUMERICAL, "lower", "upper", "q_gonality_bounds")
    # a missing cell counts as the mean
    return apply_scaler(rows, fit_scaler(rows, NUMERICAL)).fillna(0.0, list(NUMERICAL))


def _loss_table(spark: SparkSession, losses: tuple[float, ...]) -> DataFrame:
    return settle(spark.createDataFrame(list(enumerate(losses)), "epoch bigint, loss double"))


@query("e16_mlp_fit")
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir).filter(is_exact())
    return _loss_table(spark, N.mlp_fit(rows, NUMERICAL, "lower", HIDDEN, EPOCHS, rate=0.01).losses)


@query("e17_interval_fit")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled(spark, sf_dir)
    warm = N.mlp_fit(rows.filter(is_exact()), NUMERICAL, "lower", HIDDEN, WARM_EPOCHS, rate=0.01)
    fit = N.interval_fit(rows, NUMERICAL, "lower", "upper", epochs=WARM_EPOCHS, rate=0.01, start=warm.network)
    return _loss_table(spark, fit.losses)


#: Declared parameters of the mini-batch queries: networks without hidden layers, so that SQL can take their steps.
BATCHES, BATCH_EPOCHS, BATCH_RATE, BATCH_FOLDS, BATCH_SEED = 4, 3, 0.02, 2, 42


def _batch_start() -> N.Network:
    return N.new_network(len(NUMERICAL), (), seed=BATCH_SEED, final_activation=False)


def _batch_fit(spark: SparkSession, sf_dir: str, targets: tuple[str, ...], loss: N.Loss) -> BatchFit:
    """Exact rows for a point target, all rows for an interval; splits are drawn from the rows that take part."""
    rows = typed(spark, sf_dir).select("id", *NUMERICAL, "lower", "upper", "q_gonality_bounds")
    rows = apply_scaler(rows, fit_scaler(rows, NUMERICAL)).fillna(0.0, list(NUMERICAL))
    rows = rows.filter(is_exact()) if len(targets) == 1 else rows
    plan = fit_splits(rows, "id", n=BATCH_FOLDS)
    return fit_minibatches(
        rows, NUMERICAL, targets, plan, _batch_start(), BATCHES, BATCH_EPOCHS, BATCH_RATE, "SGD", BATCH_SEED, loss
    )


def _batch_sql(interval: bool) -> str:
    """CTE ``g`` (fold, epoch, role, n, loss, accuracy), one CTE per step."""
    n = len(NUMERICAL)
    weights = _batch_start().weights
    scaled = ", ".join(
        f"coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0) AS x{i}" for i, c in enumerate(NUMERICAL)
    )
    p = " + ".join([*(f"w{i} * x{i}" for i in range(n)), f"w{n}"])
    slope = "2 * (greatest(p - upper, 0) - greatest(lower - p, 0))"
    value = "greatest(p - upper, 0) ** 2 + greatest(lower - p, 0) ** 2"
    start = ", ".join(f"{w!r}::double AS w{i}" for i, w in enumerate(map(float, weights)))
    folds = f"(SELECT unnest(range({BATCH_FOLDS})) AS fold)"
    splits = SPLITS_SQL.replace("range(5)", f"range({BATCH_FOLDS})")
    parts = [
        f"WITH a AS ({TYPED_SQL}), b AS (SELECT id, lower, upper, {scaled} FROM a),"
        f" t AS (SELECT * FROM b {'' if interval else 'WHERE lower = upper'}), {splits}",
        "d AS MATERIALIZED (SELECT t.*, fold, role, ('0x' || substr(md5('"
        f"{BATCH_SEED}:' || t.id), 1, 8))::bigint % {PRIME} AS h FROM t JOIN m ON t.id = m.id)",
        f"s0 AS (SELECT fold, {start} FROM {folds})",
    ]
    state, at, logs = "s0", 0, []
    for epoch in range(BATCH_EPOCHS + 1):
        factor, shift = epoch_factors(BATCH_SEED, epoch)
        for batch in range(BATCHES if epoch else 0):
            at += 1
            dealt = f"floor((h * {factor} + {shift}) % {PRIME} * {BATCHES} / {PRIME}::double) = {batch}"
            steps = ", ".join(
                f"any_value(w{i}) - {BATCH_RATE}::double * avg({slope}{f' * x{i}' if i < n else ''}) AS w{i}" for i in range(n + 1)
            )
            parts.append(
                f"s{at} AS MATERIALIZED (SELECT fold, {steps} FROM (SELECT *, {p} AS p FROM d JOIN {state} USING (fold)"
                f" WHERE role = 'train' AND {dealt}) GROUP BY fold)"
            )
            state = f"s{at}"
        logs.append(
            f"SELECT fold, {epoch} AS epoch, role, count(*) AS n, avg({value}) AS loss,"
            f" avg((floor(p + 0.5) BETWEEN lower AND upper)::int) AS accuracy"
            f" FROM (SELECT *, {p} AS p FROM d JOIN {state} USING (fold)) GROUP BY fold, role"
        )
    return ", ".join([*parts, f"g AS MATERIALIZED ({' UNION ALL '.join(logs)}) "])


_LOG_SQL = f"SELECT {big('fold')} AS fold, {big('epoch')} AS epoch, role, {big('n')} AS n, {r6('loss')} AS loss, {r6('accuracy')} AS accuracy FROM g"


@query("e16_minibatch_log", _batch_sql(False) + _LOG_SQL)
def e16_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of mini-batch steps to a point target."""
    return settle(_batch_fit(spark, sf_dir, ("lower",), N.squared_loss).log)


@query("e17_minibatch_log", _batch_sql(True) + _LOG_SQL)
def e17_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of mini-batch steps to interval targets."""
    return settle(_batch_fit(spark, sf_dir, ("lower", "upper"), N.interval_squared_loss).log)


@query(
    "e16_best_epoch",
    _batch_sql(False) + ", gv AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY epoch) AS place FROM g WHERE role = 'valid'),"
    " gf AS (SELECT *, place = 1 OR loss < min(loss) OVER (PARTITION BY fold ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND 1 PRECEDING) AS is_best FROM gv)"
    f" SELECT {big('fold')} AS fold, {big('count(*)')} AS epochs, {big('sum(is_best::int)')} AS improved,"
    f" {big('min_by(place, (-accuracy, place))')} AS best_epoch, {r6('max(accuracy)')} AS best_accuracy FROM gf GROUP BY fold",
)
def e16_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New best flags and best epoch of every fold, read from the log of its fit."""
    log = _batch_fit(spark, sf_dir, ("lower",), N.squared_loss).log.filter("role = 'valid'")
    ordered = ordered_log(log.withColumnRenamed("epoch", "at"), "fold", "at")
    flags = new_best_flags(ordered, "loss")
    improved = flags.groupBy("fold").agg(F.count(F.lit(1)).alias("epochs"), F.count_if("is_best").alias("improved"))
    return settle(improved.join(best_epoch(ordered, "accuracy"), "fold"))
