"""Tables of the later stages: combined data, splits, metrics, results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.operators.boosting import BoostRun, coefficients
from spantab.operators.splits import SplitPlan
from spantab.sources.chunks import write_delimited

SHARED_FOLD = -1  # fold number of the sets all folds share: test and bounded


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@contextmanager
def _open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Writers by folder keep a file open for each of up to ``n`` folders instead of sorting their rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(n, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_splits(exact: DataFrame, bounded: DataFrame, plan: SplitPlan, path: str, fmt: str = "parquet") -> None:
    """Train and valid rows per fold, test and bounded rows once; one layout by (fold, role), no shuffle and no sort."""
    placed = exact.withColumn("_p", F.explode(plan.placements(SHARED_FOLD)))
    rows = placed.select(*exact.columns, "_p.fold", "_p.role").unionByName(
        bounded.withColumns({"fold": F.lit(SHARED_FOLD), "role": F.lit("bounded")}), allowMissingColumns=True
    )
    with _open_files(exact.sparkSession, 2 * len(plan.folds) + 2):
        if fmt == "csv":
            write_delimited(rows, path, header=True, partition_by=["fold", "role"], null="")
        else:
            rows.write.mode("overwrite").partitionBy("fold", "role").parquet(path)


def read_splits(spark: SparkSession, path: str, fold: int | None = None, role: str | None = None) -> DataFrame:
    """Rows of one fold (shared sets included) and role; only matching folders are read."""
    rows = spark.read.parquet(path)
    if fold is not None:
        rows = rows.filter(F.col("fold").isin(fold, SHARED_FOLD))
    return rows if role is None else rows.filter(F.col("role") == role)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    writer = metrics.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def read_metrics(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def save_results(run: BoostRun, spark: SparkSession, path: str, evaluation: DataFrame | None = None) -> None:
    """Result tables of a boosting run: features, catalogue, coefficients, progress, evaluation."""
    selected = [(i, s.name, s.body) for i, s in enumerate(run.model.stages)]
    spark.createDataFrame(selected, "position int, boosting_features string, body string").write.mode(
        "overwrite"
    ).parquet(f"{path}/selected_features")
    produced = [(r["code_str"], r["reason"], r["body"]) for r in run.catalogue.values()]
    spark.createDataFrame(produced, "code_str string, reason string, body string").write.mode("overwrite").parquet(
        f"{path}/generated_features"
    )
    named = coefficients(run.model, spark).orderBy("position").select("name", F.format_string("%.18e", "value"))
    write_delimited(named.coalesce(1), f"{path}/boosting_coefficients", sep="\t")
    progress = [(i + 1, float(a)) for i, a in enumerate(run.accuracies)]
    spark.createDataFrame(progress, "iteration int, boosting_accuracy double").write.mode("overwrite").parquet(
        f"{path}/model_progress"
    )
    if evaluation is not None:
        write_metrics(evaluation, f"{path}/model_evaluation_metrics", "csv")
