"""Queries over profiles and candidate text; the texts are whole ``conversations`` and ``part`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.functions.text import readable_name
from spantab.operators import candidates as H
from spantab.operators.profiles import null_profile
from spantab.plans.proxy import CURVES_SQL, TYPED_SQL, curves, table, typed
from spantab.plans.registry import query, r6, settle

_PROFILED = (
    "id", "level", "genus", "genus_minus_rank", "rank", "cusps", "rational_cusps", "log_conductor", "coarse_class_num",
    "coarse_level", "pointless", "contains_negative_one", "level_is_squarefree", "canonical_conjugator", "conductor",
    "q_gonality_bounds", "lower", "upper",
)


@query(
    "h1_null_profile",
    f"WITH t AS ({TYPED_SQL}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*)::bigint AS total, (count(*) - count({c}))::bigint AS nulls,"
        f" 0::bigint AS leftover, count(*) > count({c}) AS any_null FROM t" for c in _PROFILED
    ),
)
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(null_profile(typed(spark, sf_dir), _PROFILED))


@query(
    "h1_leftover_tokens",
    f"WITH c AS ({CURVES_SQL}) SELECT 'log_conductor' AS \"column\", count(*)::bigint AS total,"
    " (count(*) - count(log_conductor))::bigint AS nulls, count(*) FILTER (WHERE log_conductor = 'None')::bigint"
    " AS leftover, false AS any_null FROM c",
)
def h1_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(null_profile(curves(spark, sf_dir), ["log_conductor"]))


# A response: a function line with the whole message as the reason after it or, for some turns, as a preamble.
RESPONSE = (
    "CASE WHEN turn % 5 = 4 THEN text ELSE concat(CASE WHEN turn % 3 = 2 THEN text ELSE 'Sure:' END, chr(10), ' def f', cast(turn AS string),"
    " '(row): return log(row[\"', role, '\"] + ', cast(conv_id % 7 AS string), ')',"
    " CASE WHEN turn % 3 = 2 THEN '' ELSE concat(chr(10), 'Reason: ', text) END) END"
)
_RESPONSES = f"WITH r AS (SELECT conv_id, turn, {RESPONSE} AS text FROM conversations) "


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{RESPONSE} AS text")


_BODY_SQL = (
    r"nullif(regexp_replace(regexp_extract(text, 'def\s+(\w+)\(row\):\s*(?:return\s*)?([\s\S]+?)(?:\n\s*\n|Reason:|$)',"
    r" 2), '^\s+|\s+$', '', 'g'), '')"
)
_NAME_SQL = r"nullif(regexp_extract(text, 'def\s+(\w+)\(row\):', 1), '')"
_REASON_SQL = (
    r"CASE WHEN text LIKE '%Reason:%' THEN regexp_replace(regexp_extract(text, '(?s)Reason:\s*(.*)', 1),"
    r" '^\s+|\s+$', '', 'g') ELSE 'No reason provided.' END"
)


@query(
    "h2_parse_candidates",
    _RESPONSES + f", p AS (SELECT conv_id, turn, {_NAME_SQL} AS name, {_BODY_SQL} AS body, {_REASON_SQL} AS reason"
    " FROM r) SELECT conv_id, turn, name, CASE WHEN name IS NOT NULL THEN body END AS body,"
    " CASE WHEN name IS NOT NULL THEN reason END AS reason, 'def ' || name || '(row): return ' || body AS code_str FROM p",
)
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(H.parse_candidates(responses(spark, sf_dir)).drop("text", "readable"))


# Formula bodies spelled from part rows.
BODIES = {
    0: "concat('row[\"', p_type, '\"] ** 2 / (row[\"', p_brand, '\"] + 1e-10)')",
    1: "concat('np.log(row[\"', p_name, '\"]) - math.sqrt(', cast(p_size AS string), ' * row[\"', p_type, '\"])')",
    2: "concat('  ', cast(p_size AS string), ' * row[\"', p_brand, '\"] if row[\"', p_name, '\"] > 0 else 0 ')",
    3: "concat('row[\"', p_brand, '\"]')",
}
BODY = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, e in BODIES.items()) + " END"


def _name_sql(column: str) -> str:
    steps = [
        (r"row\[[''\"](.*?)[''\"]\]", r"\1"), (r"\*\*", "_pow_"), (r"\+", "_plus_"), (r"-", "_minus_"),
        (r"\*", "_times_"), (r"/", "_div_"), (r"\(", "_"), (r"\)", "_"), (r"\s+", "_"), ("1e-10", "eps"),
        (r"np\.", ""), (r"math\.", ""), (r"if.*else.*", "cond"), (r"[^\w]", "_"), ("_+", "_"), ("^_+|_+$", ""),
    ]
    out = f"trim({column})"
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


@query(
    "h3_readable_name",
    f"WITH b AS (SELECT p_partkey, {BODY} AS body FROM part), n AS (SELECT p_partkey, body, {_name_sql('body')} AS n"
    " FROM b), c AS (SELECT p_partkey, body, CASE WHEN length(n) > 60 THEN substr(n, 1, 57) || '...' ELSE n END AS n"
    " FROM n) SELECT p_partkey, body, CASE WHEN n = '' THEN 'custom_feature' WHEN NOT regexp_matches(n, '^[A-Za-z]')"
    " THEN 'feat_' || n ELSE n END AS readable FROM c",
)
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{BODY} AS body")
    return settle(bodies.withColumn("readable", readable_name("body")))


TEMPLATE = (
    "Columns: {{features}}.\nWrite one new column as\ndef f1(row): return ...\nReason: ...\nKnown:\n{{saved features}}\n"
)


@query(
    "h4_render_prompts",
    "WITH s AS (SELECT p_brand, p_name AS code, min(p_partkey) AS seq FROM part GROUP BY p_brand, p_name),"
    " g AS (SELECT p_brand, count(*) AS saved, string_agg(code, '\n' ORDER BY seq) AS list FROM s GROUP BY p_brand)"
    " SELECT p_brand, saved::bigint AS saved, replace(replace(replace('" + TEMPLATE + "', '{{features}}',"
    " 'level, genus'), '{{saved features}}', list), 'def f1(row):', 'def f' || (saved + 1)::varchar || '(row):')"
    " AS prompt FROM g",
)
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return settle(H.render_prompts(TEMPLATE, ["level", "genus"], parts, ["p_brand"], "p_partkey", "p_name"))


_BEFORE, _AFTER = TEMPLATE.replace("{{features}}", "level, genus").split("{{saved features}}")
_SAVED_SQL = "WITH s AS (SELECT p_brand, p_name AS code, min(p_partkey) AS seq FROM part GROUP BY p_brand, p_name),"
_NAMED_SQL = "'def f1(row):', 'def f' || (saved + 1)::varchar || '(row):'"

#: Codes of a piece of a prompt.
PIECE_CODES = 7


@query(
    "h4_prompt_pieces",
    _SAVED_SQL + " n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY seq, code) - 1 AS i,"
    " count(*) OVER (PARTITION BY p_brand) AS saved FROM s),"
    f" g AS (SELECT p_brand, saved, i // {PIECE_CODES} AS piece, string_agg(code, '\n' ORDER BY i) AS list FROM n GROUP BY ALL)"
    " SELECT p_brand, saved::bigint AS saved, piece::bigint AS piece, replace("
    f"CASE WHEN piece = 0 THEN '{_BEFORE}' ELSE '\n' END || list || CASE WHEN piece = (saved - 1) // {PIECE_CODES}"
    f" THEN '{_AFTER}' ELSE '' END, {_NAMED_SQL}) AS text FROM g",
)
def h4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return settle(
        H.render_pieces(TEMPLATE, ["level", "genus"], parts, ["p_brand"], "p_partkey", "p_name", block=PIECE_CODES)
    )


@query(
    "h4_capped_prompts",
    _SAVED_SQL + " q AS (SELECT *, md5('42:' || seq::varchar) AS h, row_number() OVER (PARTITION BY p_brand ORDER BY seq DESC)"
    " AS age, count(*) OVER (PARTITION BY p_brand) AS n FROM s),"
    " d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, age <= 8 ORDER BY h, seq) AS draw FROM q),"
    " g AS (SELECT p_brand, count(*) AS saved, string_agg(code, '\n' ORDER BY seq) AS list FROM d"
    " WHERE n <= 15 OR age <= 8 OR draw <= 7 GROUP BY p_brand)"
    f" SELECT p_brand, saved::bigint AS saved, replace('{_BEFORE}' || list || '{_AFTER}', {_NAMED_SQL}) AS prompt FROM g",
)
def h4_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return settle(H.render_prompts(TEMPLATE, ["level", "genus"], parts, ["p_brand"], "p_partkey", "p_name", cap=15))


@query(
    "h5_new_candidates",
    "SELECT p_name AS code_str, min(p_partkey)::bigint AS seq FROM part p WHERE NOT EXISTS (SELECT 1 FROM part c"
    " WHERE c.p_size <= 2 AND c.p_name = p.p_name) GROUP BY p_name",
)
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("code_str"), F.col("p_partkey").alias("seq"), "p_size"
    )
    known = parts.filter("p_size <= 2").select("code_str")
    return settle(H.new_candidates(parts.drop("p_size"), known))


@query(
    "h6_attach_catalogue",
    "WITH c AS (SELECT p_name AS body, arg_min(p_brand, p_partkey) AS code_str FROM part WHERE p_size <= 20 GROUP BY"
    f" p_name) SELECT p_partkey, p_name AS body, {r6('p_retailprice')} AS accuracy, code_str FROM part"
    " JOIN c ON p_name = body",
)
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumns({"body": F.col("p_name"), "seq": F.col("p_partkey")})
    catalogue = parts.filter("p_size <= 20").withColumn("code_str", F.col("p_brand"))
    scores = parts.select("p_partkey", "body", F.col("p_retailprice").alias("accuracy"))
    return settle(H.attach_catalogue(scores, catalogue))
