"""From raw documents to shards of training data: five stages, each written before the next reads it.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, sources are mixed to their target weights,
and the mix is cut into shards that all match it.

Rules for odd input: null and empty texts are not toxic, are near-duplicates of
each other (one stays) and are clean; the mix takes no document without words.
A null id or source is a value of its own. Repeated rows are near-duplicates;
of a group the smallest id stays. Very long texts are read whole. Further
columns of the documents pass through all stages whatever their names, but the
last one adds ``shard`` and ``slot`` in place of ones so named. Empty tables
give an empty result. A stage that loses executors is computed again from the
table that the stage before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spantab.llm import decontamination, mixing, sharding, simhash, toxicity
from spantab.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources come near their targets."""
    return mixing.mix_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The toxicity scores are compressed lengths, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, run_stage in STAGES[:-1]:
        docs = stage(run_stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
