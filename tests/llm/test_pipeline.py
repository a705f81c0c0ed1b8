"""The stages one after the other, each judged on its own input."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from spantab.llm import decontamination, simhash
from spantab.staging import stage


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    text = f"Some opening words of the page. {item} And some closing words."
    docs = docs.unionByName(spark.createDataFrame([(10**6, text, "en", "src0", len(text))], docs.schema))
    for name, run_stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(run_stage(spark, docs, sf_dir), "test-stage")
        seen[name] = docs
        if name == "sharding":
            assert docs.columns == [*columns, "shard", "slot"]
            continue
        assert docs.columns == columns
        assert docs.join(before.distinct(), columns, "left_anti").count() == 0
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before)
            want = sorted(r.component_id for r in groups.select("component_id").distinct().collect())
            assert sorted(r.doc_id for r in docs.collect()) == want
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            hits = decontamination.scan_documents(before, bench).filter(F.size("spans") > 0).select("row.doc_id")
            gone = before.join(docs, "doc_id", "left_anti").select("doc_id")
            assert sorted(hits.collect()) == sorted(gone.collect())
            assert gone.filter(f"doc_id = {10**6}").count() == 1
    sizes = Counter(r.shard for r in seen["sharding"].collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_goes_through_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0


def through_all_stages(spark, docs, sf_dir):
    for _, run_stage in corpus_pipeline.STAGES:
        docs = stage(run_stage(spark, docs, sf_dir), "test-stage")
    return docs


def test_odd_rows_go_through_all_stages(spark, sf_dir, odd):
    """Null and empty texts, null ids and sources, repeats, a long text and columns named like working columns."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = given.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd, allowMissingColumns=True)
    out = through_all_stages(spark, docs, sf_dir)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    rows = out.filter("_group is not null").collect()
    assert {r.doc_id for r in rows} == {1, None, 7, 8}  # one of the equal ones; none without words
    assert all(r.row in ("x", "y", "z") for r in rows)
    slots = Counter((r.shard, r.slot) for r in out.select("shard", "slot").collect())
    assert set(slots.values()) == {1}


def test_empty_documents_go_through_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert through_all_stages(spark, docs, sf_dir).columns == [*docs.columns, "shard", "slot"]
