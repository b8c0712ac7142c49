"""Quality rules: a table of thresholds compiled into one projection, without user functions or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import BLANK

#: Frequent function words of the corpus languages, as they stand inside a sentence.
STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this are from or an "
    "le la les de des et un une en du que qui dans est pour pas sur avec au "
    "der die das und ist von zu mit den im ein eine auf nicht sich des dem als "
    "el los las y se por con no para su al lo"
).split()

#: name, measure (an expression over the counts below), least, most; None: no bound. A document passes within all bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("words", "n_words", 20, None),
    ("repeated_words", "n_repeat_words / n_words", None, 0.3),
    ("stuttered_words", "n_stutter_words / n_words", None, 0.3),
    ("word_length", "word_chars / n_words", 2.5, 12.0),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.03, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
)
WINDOW = 8


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules read. Null text counts as empty; every count is then 0."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = [F.lit(w) for w in STOP_WORDS]

    def pairs(name: str, gap: int) -> Column:
        left = F.slice(F.col(name), F.lit(1), F.greatest(F.size(name) - gap, F.lit(0)))
        right = F.slice(F.col(name), F.lit(gap + 1), F.greatest(F.size(name) - gap, F.lit(0)))
        return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))

    df = docs.withColumn("_t", whole).withColumn("_words", F.array_remove(F.split("_t", BLANK), "")).withColumn("_lines", lines)
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    # Windows of 2, 4, then 8 words, each hashed from two of half the width.
    df = df.withColumn("_h2", pairs("_h1", 1)).withColumn("_h4", pairs("_h2", 2)).withColumn("_h8", pairs("_h4", 4))
    repeated = F.size(F.array_distinct("_h8")) < F.size("_h8")
    df = df.withColumn("_sorted", F.when(repeated, F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda j: (F.get("_sorted", j)["h"] == F.get("_sorted", j - 1)["h"]) | (F.get("_sorted", j)["h"] == F.get("_sorted", j + 1)["h"]),
    )
    df = df.withColumn("_twins", F.when(F.col("_sorted").isNotNull(), twins))
    df = df.withColumn("_starts", F.array_sort(F.transform("_twins", lambda j: F.get("_sorted", j)["i"])))
    covered = F.aggregate(
        "_starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"],
    )
    # Row numbers keep filters above this line: moved below, they would repeat each step as often as the next refers to it.
    df = df.withColumn("_at", F.monotonically_increasing_id())
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[^\x20\x09-\x0D]+", "")),
        "n_symbols": F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_at") >= 0, F.coalesce(covered, F.lit(0))),
        "n_stutter_words": F.size(F.filter(F.zip_with("_h1", F.slice("_h1", F.lit(2), F.greatest(F.size("_h1") - 1, F.lit(0))), lambda a, b: a == b), lambda same: same)),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*stops))),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•·–]"))),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    own = [c for c in docs.columns if c not in counts]
    return df.select(*own, *(v.cast("long").alias(k) for k, v in counts.items()))


def verdicts(measured: DataFrame, rules=RULES) -> DataFrame:
    """measured with failed_rules (names, in the table's order), base_failed and kept."""

    def broken(measure: str, least, most) -> Column:
        top, _, below = measure.partition(" / ")
        value = F.col(top).cast("double") / F.when(F.col(below) > 0, F.col(below)) if below else F.col(top).cast("double")
        bad = F.lit(False)
        if least is not None:
            bad = bad | (value < F.lit(float(least)))
        if most is not None:
            bad = bad | (value > F.lit(float(most)))
        return F.coalesce(bad, F.lit(False))

    names = F.array(*(F.when(broken(m, lo, hi), F.lit(name)) for name, m, lo, hi in rules))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = measured.withColumn("failed_rules", F.array_compact(names)).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules of every row of docs; rows stay in place, repeated ones too.

    Null or empty text fails the base. Other columns of docs aren't returned, so clashing names don't matter."""
    return verdicts(measures(docs.select("doc_id", "text"))).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs as they came."""
    held = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return verdicts(measures(held)).where("kept").select("_row.*")
