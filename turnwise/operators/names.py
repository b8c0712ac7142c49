"""Names of families of files: `name`, `name (2)`, `name (3)`, ... so that no two families share a name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.sources import views

#: What a number leaves behind a name: names that can become equal by numbers have the same root.
_NUMBERS = r"( \(([2-9]|[1-9][0-9]+)\))+$"


def _numbered(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a root in order: each takes the first name of its stem that is free."""
    taken = set(group.loc[group["_taken"], "stem"])
    nexts: dict[str, int] = {}
    rows, names = group[~group["_taken"]].sort_values(["_order", "_row"]), []
    for stem in rows["stem"]:
        k = nexts.get(stem, 1)
        while (name := stem if k == 1 else f"{stem} ({k})") in taken:
            k += 1
        nexts[stem] = k + 1
        taken.add(name)
        names.append(name)
    return pd.DataFrame({"_stem": rows["stem"].to_list(), "_row": rows["_row"].to_list(), "name": names})


def unique_names(files: DataFrame, order: str, taken: DataFrame | None = None) -> DataFrame:
    """files (stem, ...) with name: what a run that goes through files by `order` calls each, where a family gets the first of
    `stem`, `stem (2)`, ... that neither an earlier family nor `taken` (name) has. Stems may look like numbered names themselves.

    Where all files of a root have one stem and none of its names is taken, a row number is the answer. Only roots whose stems
    can collide are gone through in order, with the names given so far as state; those need no more than a number a stem and the
    names themselves. Null stems count as empty; rows of equal order are numbered in any order; names of `taken` that are
    repeated or belong to no root do nothing."""
    root = lambda c: F.regexp_replace(c, _NUMBERS, "")
    kind = files.schema[order].dataType.simpleString()
    rows = files.withColumn("_stem", F.coalesce("stem", F.lit(""))).withColumn("_root", root(F.col("_stem")))
    stems = rows.groupBy("_root").agg(F.countDistinct("_stem").alias("_n"))
    used = files.sparkSession.createDataFrame([], "stem string") if taken is None else taken.select(F.col("name").alias("stem")).where("stem IS NOT NULL").distinct()
    used = used.withColumn("_root", root(F.col("stem")))
    hard = stems.join(used.select("_root", F.lit(True).alias("_used")).distinct(), "_root", "left").where("_n > 1 OR _used").select("_root")
    number = F.row_number().over(Window.partitionBy("_stem").orderBy(order))
    plain = rows.join(hard, "_root", "left_anti").withColumn("name", F.when(number == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit(" ("), number.cast("string"), F.lit(")"))))
    # Only orders and stems meet in the tasks; the rows join their names by place.
    place = Window.partitionBy("_stem").orderBy(order)
    rest = rows.join(hard, "_root", "left_semi").withColumn("_row", F.row_number().over(place))
    both = rest.select("_root", F.col("_stem").alias("stem"), F.col(order).alias("_order"), "_row", F.lit(False).alias("_taken"))
    both = both.unionByName(used.join(hard, "_root", "left_semi").select("_root", "stem", F.lit(None).cast(kind).alias("_order"), F.lit(0).alias("_row"), F.lit(True).alias("_taken")))
    given = both.groupBy("_root").applyInPandas(_numbered, "_stem string, _row int, name string")
    out = plain.select(*files.columns, "name") if "name" not in files.columns else plain.select(*[c for c in files.columns if c != "name"], "name")
    return out.unionByName(rest.drop("name").join(given, ["_stem", "_row"]).select(*out.columns))


def unique_names_query(spark, sf_dir):
    """Names for the documents in the order of their ids: their stem is their source, numbered already in two languages, and every
    source's third name is taken."""
    docs = views.read(spark, sf_dir, "documents")
    stem = F.when(F.col("lang") == "de", F.concat("source", F.lit(" (2)"))).when(F.col("lang") == "fr", F.concat("source", F.lit(" (2) (2)"))).otherwise(F.col("source"))
    taken = docs.select(F.concat("source", F.lit(" (3)")).alias("name")).distinct()
    return unique_names(docs.select("doc_id", stem.alias("stem")), "doc_id", taken).select("doc_id", "stem", "name")


ORACLE = """WITH RECURSIVE f AS (SELECT doc_id, source AS root, source || CASE lang WHEN 'de' THEN ' (2)' WHEN 'fr' THEN ' (2) (2)' ELSE '' END AS stem, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g AS (SELECT DISTINCT root, 0::BIGINT AS r, [root || ' (3)'] AS taken, 0::BIGINT AS doc_id, '' AS stem, '' AS name FROM f
  UNION ALL SELECT f.root, f.r, list_append(taken, fresh), f.doc_id, f.stem, fresh FROM (SELECT g.root, g.r, g.taken, f.doc_id AS d, f.stem AS s,
    list_filter(list_transform(range(1, len(g.taken) + 3), lambda k: f.stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END), lambda x: NOT list_contains(g.taken, x))[1] AS fresh FROM g JOIN f ON f.root = g.root AND f.r = g.r + 1) y JOIN f ON f.root = y.root AND f.r = y.r + 1)
SELECT doc_id, stem, name FROM g WHERE r > 0"""
OWN = {"unique_names": (unique_names_query, ORACLE)}
