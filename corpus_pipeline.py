"""Pipeline from raw documents to shards: each stage is written as Parquet and read again by the next.

Every stage takes whole tables as they come. A null or empty text scores by the model's bias, shares one
near-duplicate group with all texts without words, has no words to contaminate, and is mixed and sharded as
an empty text. A row without doc_id stays only if nothing of its group has one; a null source is a source of
its own. Repeated rows and ties: of a group, the row of the smallest doc_id stays (by a hash of the row if
several have it). Without usable labels there is no model, and every document passes. Empty tables pass as
empty tables. Columns beside those of documents pass unchanged, but for those named like the last stage's
outputs (shard, slot, size, text_crc32, law), which give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermocline.llm import decontaminate, mixing, sharding, simhash, toxicity
from thermocline.llm.common import read, written

#: Stages fit a model, link near copies and hash with seeds: SQL does not express their rows.
ORACLE_SQL = None
SHARDS = 16


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay; labels only teach the model."""
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, weights)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go, the others stay as they are."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream in which sources hold their target weights: every document once, those of
    sources below their target again in further epochs, in the order of the stream."""
    return mixing.stream(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture with their shard and slot; every shard holds the mixture."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
