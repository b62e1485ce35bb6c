"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelith.llm import common, decontam, langid, mixing, neardup, sharding

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject."""
    return langid.accepted(docs, clusters=4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id."""
    return neardup.dedup(docs, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.8, k=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of sources above their target go, of sources below it come twice."""
    return mixing.mixed(docs, weights=(5, 2, 1), share=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; a column of theirs that has a name of these comes as ``input_`` and its name."""
    own = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c.lower() in own})
    return sharding.assign_shards(docs, [1.0] * SHARDS, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL can't express the learned and the hashed stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), common.scratch(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
