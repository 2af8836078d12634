"""The corpus pipeline: stages that each apply one operator to all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import op2_simhash, op5_repetition, op6_kdtree, op8_latent, op9_raking
from studyloom.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text fails the base rules or is mostly repetition."""
    return op5_repetition.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id."""
    return op2_simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    return op8_latent.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of four fifths of the tokens whose sources, languages and topics are raked to their target weights."""
    return op9_raking.sampled(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard of equal bytes and a slot in it for each document that is left."""
    return op6_kdtree.shard(docs, 16).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]

#: XXH64 fingerprints, the latent space and raking are beyond SQL; tests hold the first three stages against brute force, and
#: what run() gives against the laws of the last two.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
