"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import decontamination, extraction, fill_middle, language, licenses, mixing, ngram_join, pii, quality, search, sentencepieces, sharding, warc
from turnwise.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the licence sentences found and the licence that the first matching rule names."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: a row for each document and item that overlap in a window of 13 words."""
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with numbers, dates, addresses and secrets replaced by keyed pseudonyms of the same format."""
    return pii.pseudonyms(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by jump hashing of doc_id (law `key`), with places in the shard and the shard of nine."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of links: sets of 4-word shingles with a Jaccard similarity of 0.85 and more."""
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as often as its source's Poisson count says, in a global random order."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives, equal payloads as revisits, and read back from them."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the counts and ratios of the rules and the verdict."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with their main text."""
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their predicted language; learnt from the labelled ones that aren't held out."""
    return language.identify(table(spark, sf_dir, "documents"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, with checksums of the outputs and of the texts rebuilt from them."""
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=42))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """All documents as ids of the 32,000 pieces of `model` (a public model where it is unset) and back."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.digests(sentencepieces.encode_decode(table(spark, sf_dir, "documents"), model))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_pii_pseudonyms, op4_sharding, op5_ngram_jaccard, op6_source_mixing, op7_warc, op8_quality_rules, op9_main_text, op10_language_id, op11_block_max_search, op12_fill_in_middle, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle(), "op6_source_mixing": mixing.oracle(), "op7_warc": warc.oracle(), "op11_block_max_search": search.oracle(), "op12_fill_in_middle": fill_middle.oracle()}
