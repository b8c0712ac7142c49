"""Connected components of a link table, distributed: alternating stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Scratch


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): every node's neighbours (the larger ones, or those up to itself) are linked to its least."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, label: the least node of the component of every node that a link (u, v) of longs names. Links to oneself count for nothing.

    Each round is written to the shared folder and the one before it dropped; it ends when a round changes no link, which takes
    a number of rounds that grows with the logarithm of the longest path."""
    scratch = scratch or Scratch(links.sparkSession)
    now, held = links.select("u", "v").where("u <> v").distinct(), None
    before = None
    while True:
        now = scratch.write(_stars(_stars(now, True), False), "stars")
        if held is not None:
            scratch.drop(held)
        held = now
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
