"""The corpus pipeline: quality, near duplicates, benchmark decontamination, source mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. `run` writes
each stage's rows to the shared checkpoint folder, reads them as the next one's documents, and then drops them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cleave.llm import decontaminate, minhash, mixing, quality, sharding
from cleave.session import release, remove, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the classifier's threshold; null texts score as empty ones. Null and repeated ids are rows of their own.

    Without labels every document stays; an empty table gives an empty one.
    """
    machine = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, machine)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id (nulls last) and, of rows of one id, the least hash of its text.

    Wordless texts are groups of their own: each id keeps one row of each such text, and rows without an id all stay. Extra columns
    go along; an empty table gives an empty one.
    """
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; null and wordless texts have none and stay, whatever their id."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Wordless and null texts carry no weight and go.

    Null and repeated ids: each row counts by itself, and rows that are equal in all columns stand in for one another.
    """
    return mixing.repeat_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, also of null and repeated ids and null texts; extra columns are not returned."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Classifier, sketches, knapsack and packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages wrote before is removed; the last one's own folder, from which the result is read, stays."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what the stage read is no longer needed
            remove(spark, before)
        before = path
        release(spark)
    return docs
