"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, mix, shards.

Stages take any columns besides those of documents, whatever their names, and give them back; an empty table passes through
all of them as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkforge.llm import decontam, mixing, quality, sharding, simhash
from linkforge.llm.common import Scratch

#: Share of the words that reach the mix and that it takes; no document more than once.
MIX_RATIO, SHARDS = 0.8, 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; texts stay whole.

    Null, empty and short texts are rejected by the base rules; repeated rows share their verdict.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates.

    Rows that repeat it are cut to one; a null id stays only where its group has no other. Texts without words are one
    group.
    """
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Row by row: null texts and ids hold none, repeated rows share their verdict; benchmark rows with nulls are passed over.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that bring the sources to their target weights.

    Null languages and sources are names of their own; rows that share id and text are taken together; texts without
    words stay where their leaf is taken whole.
    """
    return mixing.mixed(docs, MIX_RATIO)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left: repeated rows have a slot each, null ids go where key 0 goes."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("quality_rules", keep_quality), ("simhash_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", put_into_shards)]

#: Hash orders and fingerprints aren't expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
