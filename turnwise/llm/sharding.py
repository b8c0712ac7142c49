"""Jump consistent hashing of stable keys to shards, without a ring table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published jump hash: the multiplier of its linear congruential step, and the modulus of 64-bit words.
_STEP = Decimal(2862933555777941757)
_WORD = Decimal(1 << 64)


def jump_hash(key, shards: int):
    """(shard among `shards`, shard among `shards` + 1) of a 64-bit key, as a struct column.

    The chain of jumps depends on the key alone, so one walk gives both: the last jump below each count. A null key counts as 0.
    Arithmetic modulo 2^64 runs in decimals, as Spark's long arithmetic reports overflow."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(
        F.pmod(F.coalesce(key.cast("decimal(20,0)"), F.lit(Decimal(0))), F.lit(_WORD)).cast("decimal(20,0)").alias("state"),
        F.lit(0).cast("long").alias("jump"), F.lit(0).alias("at"), F.lit(0).alias("grown"),
    )

    def step(acc, _):
        state = ((acc["state"] * F.lit(_STEP) + F.lit(Decimal(1))) % F.lit(_WORD)).cast("decimal(20,0)")
        top = F.floor(state / F.lit(Decimal(1 << 33))).cast("double")
        jump = F.floor((acc["jump"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1.0))).cast("long")
        here = acc["jump"].cast("int")
        return F.when(acc["jump"] > shards, acc).otherwise(
            F.struct(state.alias("state"), jump.alias("jump"), F.when(acc["jump"] < shards, here).otherwise(acc["at"]).alias("at"), here.alias("grown"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda acc: F.struct(acc["at"].alias("shard"), acc["grown"].alias("grown_shard")))


def with_slots(df: DataFrame, shard: str, order: list[str | Column], shuffled: bool = False, buckets: int = 4096) -> DataFrame:
    """Add slot: gapless from 0 within each shard, in place of a column of that name.

    A shard is never sorted in one task: its rows fall into `buckets` hash buckets of the order, are numbered there, and get
    the number of rows in the shard's earlier buckets added. The table of those sums has shards x buckets rows at most,
    whatever the input, and is broadcast. shuffled: within a bucket, by a hash of the row's place in that order, so that equal
    rows don't stand side by side."""
    held = df.drop("slot")
    rows = held.select(F.struct("*").alias("_row"), F.col(shard).alias("_shard"), F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("_bucket"), F.struct(*order).alias("_order"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_order")))
    if shuffled:
        numbered = numbered.withColumn("_place", F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy(F.xxhash64("_shard", "_bucket", "_place"), "_place")))
    return numbered.join(F.broadcast(sums), ["_shard", "_bucket"]).select("_row.*", (F.col("_place") - 1 + F.col("_before")).cast("long").alias("slot"))


def shard_rows(df: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """df with shard and grown_shard (the shard once one more is appended), from the key and the shard count alone.

    Null keys count as key 0; equal keys share a shard; an empty table gives an empty one. Columns of df that are named shard
    or grown_shard are replaced."""
    kept = df.drop("shard", "grown_shard")
    jumped = kept.select(F.struct("*").alias("_row"), jump_hash(F.col(key), shards).alias("_jump"))
    return jumped.select("_row.*", "_jump.shard", "_jump.grown_shard")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    Null text: size 1, checksum 0 (that of no bytes). Repeated rows each get a slot of their own. The text is read once and
    never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_slots(shard_rows(narrow, shards), "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
