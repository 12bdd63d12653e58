"""From raw documents to shuffled training shards.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept
and returns a frame that is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedframe.llm import leakage, mixing, neardup, quality, sharding
from feedframe.llm.queries import crc_fold, table
from feedframe.session import materialize

#: Documents that score below are rejected.
LEAST_QUALITY = 0.5

#: No SQL: the classifier and the random orders cannot be expressed in it.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), crc_fold(4, 2), column="_quality")
    return scored.where(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return leakage.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order, written to shards, with their shard and slot."""
    return sharding.write_shards(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
