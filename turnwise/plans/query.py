"""A query: SQL over named tables, run by Spark on DataFrames and by DuckDB as the check."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from turnwise.sources import views


def _names(text: str) -> list[str]:
    return [v for v in (*views.VIEWS, *views.TABLES) if re.search(rf"\b{v}\b", text)]


@dataclass
class Query:
    """sql: text in the part of SQL that both engines read. duck: (from, to) replacements for DuckDB's spelling."""

    sql: str
    duck: tuple[tuple[str, str], ...] = ()
    duck_sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return over(spark, self.sql, {n: views.VIEWS[n](spark, sf_dir) if n in views.VIEWS else views.read(spark, sf_dir, n) for n in _names(self.sql)})

    def oracle(self) -> str:
        text = self.duck_sql or self.sql
        for a, b in self.duck:
            if a not in text:
                raise ValueError(f"{a!r} isn't in the query")
            text = text.replace(a, b)
        return with_views(text)


def with_views(text: str) -> str:
    """DuckDB text with the views that it reads put before it."""
    wanted: list[str] = []
    for v in _names(text):
        for x in (*views.NEEDS.get(v, ()), v):
            if x in views.DUCK and x not in wanted:
                wanted.append(x)
    if not wanted:
        return text
    head = ",\n".join(views.DUCK[v] for v in wanted)
    body = text.strip()
    if (m := re.match(r"WITH\s+(RECURSIVE\s+)?", body)) is not None:
        return f"WITH {m[1] or ''}{head},\n{body[m.end():]}"
    return f"WITH {head}\n{body}"


def over(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Run Spark SQL on DataFrames, each under its name. Numbers with a point are doubles, as in the reference."""
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", text)
    text = text.replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = re.sub(rf"(\b(?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", text)
    return spark.sql(text, **{k: v for k, v in tables.items() if f"{{{k}}}" in text})
