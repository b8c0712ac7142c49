"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next. All but the last return the columns of documents; the last adds shard, slot and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import decontamination, mixing, ngram_join, quality, sharding
from turnwise.llm.common import table, written

SHARDS = 8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go; null and empty texts fail its base rules."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams and a Jaccard index of 0.8, that of least doc_id stays."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark table go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a Poisson draw of its source's rate says, in a global random order. Sources are to have shares
    that go with their size to the power 0.7; the mixture is as large as what comes in."""
    return mixing.mix(docs).select(*docs.columns)


def jump_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 8, its place in the shard and its shard among 9. Copies of a document share a shard, but places
    go by a hash, so that the mixture's copies don't stand side by side."""
    columns = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    order = [F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    placed = sharding.with_slots(sharding.shard_rows(docs.select(*columns), SHARDS), "shard", order, shuffled=True)
    return placed.select(*columns, "shard", "slot", "grown_shard")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("jump_sharding", jump_sharding),
]

#: N-gram components, spaced seeds and 64-bit stepping aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
