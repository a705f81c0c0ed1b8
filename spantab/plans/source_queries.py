"""Queries over readers and writers: each writes the given rows out and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.operators import splits as S
from spantab.operators.boosting import boosted_predict
from spantab.operators.cleaning import expand_list, split_exact_bounded
from spantab.operators.metrics import metrics
from spantab.plans.cleaning_queries import DIRTY_SQL, dirty
from spantab.plans.model_queries import fixed_boost
from spantab.plans.proxy import PREDICTIONS_SQL, TYPED_SQL, curves, predictions, table, typed, typed_rows
from spantab.plans.registry import big, query, r6, settle
from spantab.plans.metric_queries import _P, _metrics_sql
from spantab.plans.split_queries import FRAC, SPLITS_SQL, hash_sql
from spantab.sources import chunks as A
from spantab.sources import tables as W
from spantab.staging import stage, staging_path

SIZE = 1000
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*ORDERS)


_CHUNK = f"floor(o_orderkey / {SIZE})::bigint"


@query(
    "a2_id_range_chunk",
    f"SELECT {_CHUNK} AS chunk, 'ranks' || ({_CHUNK})::varchar || '.csv' AS file_name, count(*)::bigint AS n,"
    " min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders GROUP BY ALL",
)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.id_range_chunk(_orders(spark, sf_dir), "o_orderkey", SIZE, "ranks{i}.csv")
    return settle(
        rows.groupBy("chunk", "file_name").agg(
            F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lowest"), F.max("o_orderkey").alias("highest")
        )
    )


_ORDERS_SQL = f"o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice, o_orderpriority"


@query("a3_write_delimited", "SELECT doc_id, text, lang FROM documents")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, separators, quotes and line breaks included, survive the round trip."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = staging_path(spark, "delimited")
    A.write_delimited(rows, path)
    return settle(A.read_headerless(spark, path, rows.schema, multiline=True))


@query("a5_read_headerless", f"SELECT {_ORDERS_SQL} FROM orders")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    path = staging_path(spark, "headerless")
    A.write_delimited(rows, path)
    return settle(A.read_headerless(spark, [path, f"{path}-absent"], rows.schema))


@query("a6_read_chunks", f"SELECT {_ORDERS_SQL}, {_CHUNK} AS chunk FROM orders WHERE {_CHUNK} >= 1")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    path = staging_path(spark, "chunks")
    A.write_chunks(rows, path, "o_orderkey", SIZE)
    return settle(A.read_chunks(spark, path, 1, 1 << 40, rows.schema))


@query(
    "a7_sample_chunks",
    f"WITH o AS (SELECT *, {_CHUNK} AS chunk FROM orders), h AS (SELECT max(chunk) + 1 AS high FROM o),"
    " c AS (SELECT unnest(range(high)) AS chunk, high FROM h),"
    " s AS (SELECT chunk FROM c QUALIFY row_number() OVER (ORDER BY md5('42:' || chunk::varchar), chunk)"
    f" <= (high + 1) // 2) SELECT {_ORDERS_SQL}, chunk FROM o WHERE chunk IN (SELECT chunk FROM s)",
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.id_range_chunk(_orders(spark, sf_dir), "o_orderkey", SIZE)
    high = rows.agg(F.max("chunk")).first()[0] + 1
    return settle(A.sample_chunks(rows, (high + 1) // 2, 0, high))


@query(
    "a8_combine_chunks",
    f"WITH d AS ({DIRTY_SQL}), c AS (SELECT o_orderkey, trim(priority, ' \t') AS priority,"
    " CASE WHEN status IN ('None', 'null', 'N/A', 'NaN', '') THEN NULL ELSE status END AS status,"
    " trim(price) AS price FROM d) SELECT o_orderkey::varchar AS o_orderkey, priority, status, price FROM c"
    f" WHERE status IS NOT NULL AND floor(o_orderkey / {5 * SIZE})::bigint % 3 <> 2",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with untidy headers; every third chunk lacks a wanted column, so its rows drop out."""
    rows = dirty(spark, sf_dir)
    path = staging_path(spark, "dirty")
    untidy = {"o_orderkey": "o_orderkey", "priority": " priority ", "status": "status", "price": "  price"}
    kept = rows.filter(A.chunk_number("o_orderkey", 5 * SIZE) % 3 != 2).withColumnsRenamed(untidy)
    lacking = rows.filter(A.chunk_number("o_orderkey", 5 * SIZE) % 3 == 2).drop("status")
    A.write_chunks(kept, f"{path}/full", "o_orderkey", 5 * SIZE, header=True)
    A.write_chunks(lacking, f"{path}/lacking", "o_orderkey", 5 * SIZE, header=True)
    paths = [p for part in ("full", "lacking") for p in A.chunk_paths(spark, f"{path}/{part}", 0, 1 << 40)]
    return settle(A.combine_chunks(spark, [*paths, f"{path}/absent"], ["o_orderkey", "priority", "status"], "price"))


_REASONS = {1: "a line is longer than the header", 2: "broken file", 3: "no wanted column"}


@query(
    "a8_quarantine",
    f"WITH d AS ({DIRTY_SQL}), c AS (SELECT floor(o_orderkey / {5 * SIZE})::bigint AS chunk, status IS NOT NULL AND"
    " status NOT IN ('None', 'null', 'N/A', 'NaN', '') AS whole FROM d)"
    " SELECT chunk, CASE chunk % 4 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in _REASONS.items())
    + " ELSE 'kept' END AS reason, CASE WHEN chunk % 4 = 0 THEN count(*) FILTER (whole) ELSE 0 END::bigint AS n_rows"
    " FROM c GROUP BY chunk",
)
def a8_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every four chunks one is whole; the others have long lines, a broken body, or no wanted column."""
    chunk = A.chunk_number("o_orderkey", 5 * SIZE)
    rows = dirty(spark, sf_dir).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint")).withColumn("chunk", chunk)
    path = staging_path(spark, "quarantine")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("o_orderkey", "status")]
    line = F.concat_ws(";", *cells, F.when(F.col("chunk") % 4 == 1, "beyond"))
    header = F.when(F.col("chunk") % 4 == 3, "key;state").otherwise("o_orderkey;status")
    lines = rows.select("chunk", F.lit(1).alias("place"), line.alias("value")).unionByName(
        rows.select("chunk", F.lit(0).alias("place"), header.alias("value")).distinct()
    )
    placed = lines.repartition("chunk").sortWithinPartitions("chunk", "place").select("chunk", "value")
    placed.write.partitionBy("chunk").text(path)
    files = [(k, f) for k in A.chunk_paths(spark, path, 0, 1 << 40) for f, _ in A._data_files(spark, k)]
    for folder, file in files:
        if int(folder.rsplit("=", 1)[1]) % 4 == 2:  # plain text under the name of a compressed file breaks in its body
            fs, place = A._file_system(spark, file)
            fs.rename(place, A._file_system(spark, f"{file}.gz")[1])
    scan = A.scan_chunks(spark, [folder for folder, _ in files], "o_orderkey", "status")
    number = F.regexp_extract("file", r"chunk=(\d+)", 1).cast("bigint")
    bad = scan.quarantine.select(number.alias("chunk"), "reason", F.lit(0).cast("bigint").alias("n_rows"))
    kept = scan.rows.groupBy(A.chunk_number(F.col("o_orderkey").cast("bigint"), 5 * SIZE).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return settle(bad.unionByName(kept.withColumn("reason", F.lit("kept"))))


@query("a9_table_round_trip", f"SELECT {_ORDERS_SQL} FROM orders")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "table")
    W.write_table(_orders(spark, sf_dir), path)
    return settle(W.read_table(spark, path))


def _written_splits(spark: SparkSession, sf_dir: str) -> str:
    rows = stage(typed(spark, sf_dir).select("id", "level", "lower", "upper"), "typed")
    exact_rows, bounded = rows.filter("lower = upper"), rows.filter("lower <> upper")
    path = staging_path(spark, "splits")
    W.write_splits(exact_rows, bounded, S.fit_splits(exact_rows, "id"), path)
    return path


_SPLIT_SETS_SQL = f"""WITH t AS ({TYPED_SQL}), x AS (SELECT id, level FROM t WHERE lower = upper),
k AS (SELECT DISTINCT id FROM x),
h AS (SELECT id, row_number() OVER (ORDER BY {hash_sql('id', "'42'")}, id) <= ceil((SELECT count(*) FROM k)::double * 0.1)
      AS is_test FROM k),
rest AS (SELECT id FROM h WHERE NOT is_test),
f AS (SELECT id, fold, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('id', "(42 + fold)::string")}, id)
      <= ceil((SELECT count(*) FROM rest)::double * {FRAC!r}::double) AS is_valid
      FROM rest CROSS JOIN (SELECT unnest(range(5)) AS fold) s),
w AS (SELECT fold, CASE WHEN is_valid THEN 'valid' ELSE 'train' END AS role, level FROM x JOIN f ON x.id = f.id
      UNION ALL SELECT -1, 'test', level FROM x JOIN h ON x.id = h.id WHERE is_test
      UNION ALL SELECT -1, 'bounded', level FROM t WHERE lower <> upper) """


@query(
    "a10_write_splits",
    _SPLIT_SETS_SQL + "SELECT fold::bigint AS fold, role, count(*)::bigint AS n, sum(level)::bigint AS levels"
    " FROM w GROUP BY fold, role",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.read_splits(spark, _written_splits(spark, sf_dir))
    return settle(rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels")))


@query(
    "a13_read_splits",
    _SPLIT_SETS_SQL + "SELECT role, count(*)::bigint AS n, sum(level)::bigint AS levels FROM w"
    " WHERE fold IN (-1, 2) GROUP BY role",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.read_splits(spark, _written_splits(spark, sf_dir), fold=2)
    return settle(rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels")))


@query(
    "a11_write_metrics",
    _P + f"SELECT fold::bigint AS fold, role, {_metrics_sql('g')} FROM q WHERE is_exact GROUP BY fold, role",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics(predictions(spark, sf_dir).filter("is_exact"), by=["fold", "role"])
    path = staging_path(spark, "metrics")
    W.write_metrics(made, path)
    return settle(W.read_metrics(spark, path, made.schema))


@query("a12_save_results", f"""WITH p AS ({PREDICTIONS_SQL}) SELECT r.name, r.value, n::bigint AS n FROM (VALUES
  ('poly_genus', 0.5::double), ('poly_level', 0.1), ('poly_intercept', 0.6), ('residual_ratio', 0.3),
  ('residual_ratio_intercept', 0.05), ('residual_logs', -0.6), ('residual_logs_intercept', 0.02)) r(name, value),
  (SELECT count(*) AS n FROM p) c""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spantab.operators.boosting import BoostRun

    model = fixed_boost()
    rows = typed(spark, sf_dir)
    scored = boosted_predict(rows, model).agg(F.count("p").alias("n"))
    path = staging_path(spark, "results")
    W.save_results(BoostRun(model, model, [50.0]), spark, path, scored)
    named = A.read_headerless(
        spark, f"{path}/boosting_coefficients", T.StructType.fromDDL("name string, value double"), sep="\t"
    )
    n = W.read_metrics(spark, f"{path}/model_evaluation_metrics", "n bigint", "csv").first()["n"]
    return settle(named.withColumn("n", F.lit(n)))


_FLOW_KEY = ("level", "genus", "rank", "cusps", "rational_cusps", "coarse_class_num", "canonical_conjugator")


@query(
    "flow_chunks_to_splits",
    f"WITH a AS (SELECT * FROM ({TYPED_SQL}) b WHERE log_conductor IS NOT NULL),"
    f" u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY {', '.join(_FLOW_KEY)}, lower, upper ORDER BY id) = 1),"
    " t AS (SELECT * FROM u WHERE lower = upper)," + SPLITS_SQL
    + ", r AS (SELECT fold, role, level, t.id FROM m JOIN t ON m.id = t.id"
    " UNION ALL SELECT -1, 'bounded', level, id FROM u WHERE lower <> upper)"
    f" SELECT {big('fold')} AS fold, role, {big('count(*)')} AS n, {big('sum(level)')} AS levels, min(id) AS first FROM r GROUP BY fold, role",
)
def chunks_to_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chunk files to split sets: cleaning scan, types, lists, deduplication, exact and bounded rows, five splits."""
    raw = curves(spark, sf_dir)
    path = staging_path(spark, "flow")
    A.write_chunks(raw, path, "coarse_class_num", 3, header=True)
    scalars = T.StructType([f for f in raw.schema.fields if f.name != "log_conductor"])
    names = [c for c in raw.columns if c != "q_gonality_bounds"]
    scan = A.scan_chunks(spark, A.chunk_paths(spark, path, 0, 6), names, "q_gonality_bounds", schema=scalars)
    rows = expand_list(typed_rows(scan.rows), "canonical_conjugator")
    lists = [f"canonical_conjugator_{i}" for i in range(4)]
    key = [*(c for c in _FLOW_KEY if c != "canonical_conjugator"), *lists, "lower", "upper"]
    unique = stage(S.dedup_first(rows.select("id", *key, "q_gonality_bounds"), key, "id"), "flow-unique")
    exact_rows, bounded = split_exact_bounded(unique)
    plan = S.fit_splits(exact_rows, "id", n=5, assume_unique=True)
    beside = F.array(F.struct(F.lit(-1).alias("fold"), F.lit("bounded").alias("role")))
    placed = exact_rows.select("id", "level", plan.placements().alias("m"))
    every = placed.unionByName(bounded.select("id", "level", beside.alias("m")))
    # Rows are added up by all their places together, and these sums by place: no row is copied for each fold.
    alike = every.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels"), F.min("id").alias("first"))
    single = alike.select(F.explode("m").alias("m"), "n", "levels", "first").select("m.fold", "m.role", "n", "levels", "first")
    return settle(single.groupBy("fold", "role").agg(
        F.sum("n").alias("n"), F.sum("levels").alias("levels"), F.min("first").alias("first")
    ))
