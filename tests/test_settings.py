"""Presets, outcomes, checks of files, glossaries and stamps, by literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from turnwise.functions import scalars
from turnwise.operators import settings
from turnwise.plans import shared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [("Rápido", ("Rápido", "small", "Rapido", True, "Auto", "Rápida")), ("Preciso", ("Preciso", "medium", "Preciso", True, "Auto", "Equilibrada")), ("Personalizado", ("Personalizado", None, None, None, None, None)), (None, ("Equilibrado", "small", "Equilibrado", True, "Auto", "Equilibrada")), ("x", ("Equilibrado", "small", "Equilibrado", True, "Auto", "Equilibrada"))])
def test_presets(spark, name, want):
    assert tuple(one(spark, settings.preset(F.lit(name).cast("string")))) == want


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (("medium", "Preciso", "Precisa", None, None), "Preciso"), (("medium", "Preciso", "Equilibrada", None, None), "Personalizado"), (("medium", "Preciso", "Equilibrada", True, "Auto"), "Preciso"), (("medium", "Preciso", "Precisa", True, "Auto"), "Personalizado"),
        (("small", "Rapido", "Rápida", True, None), "Rápido"), (("small", "Rapido", "Rápida", None, "2"), "Personalizado"), (("small", "Rapido", "Rápida", False, "Auto"), "Personalizado"), (("small", "Equilibrado", "Equilibrada", True, "Auto"), "Equilibrado"), ((None, "Rapido", "Rápida", True, "Auto"), "Personalizado"),
    ],
)
def test_inferred_presets(spark, values, want):
    kinds = ("string", "string", "string", "boolean", "string")
    assert one(spark, settings.inferred(*(F.lit(v).cast(k) for v, k in zip(values, kinds, strict=True)))) == want


def test_checked_files(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("é", 2, sha("é").upper(), "bad"), (None, 2, None, None), ("é", 1, sha("é"), None), ("é", None, sha("x"), sha("é")), ("é", 2, None, sha("x")), ("é", 2, None, None), ("", 0, None, sha(""))]
    got = settings.checked(spark.createDataFrame(rows, "text string, size long, digest string, pinned string")).collect()
    assert [r.status for r in got] == ["ok", "missing", "size", "hash", "hash", "ok", "ok"]


def test_outcomes_and_glossaries(spark):
    assert [one(spark, settings.outcome(F.lit(a), F.lit(b))) for a, b in ((0, 0), (3, 0), (0, 2), (1, 2))] == ["complete", "complete", "total_fail", "partial"]
    assert one(spark, settings.glossary_list(F.lit(" b, a;;b\n c d ,A"))) == ["b", "a", "c d", "A"] and one(spark, settings.glossary_list(F.lit(None).cast("string"))) == []


def test_stamps(spark):
    at = lambda t: one(spark, scalars.stamp_of_seconds(F.lit(t)))
    assert [at(t) for t in (0.0005, 0.0015, 1.0625, 3661.5, 360000.0, -1.0)] == ["00:00:00,000", "00:00:00,002", "00:00:01,062", "01:01:01,500", "100:00:00,000", "00:00:00,000"]
    assert one(spark, scalars.simple_stamp(F.lit(59.9996))) == "00:00:59"


def test_one_folder_for_all_tables(spark):
    import os

    path = shared.place(spark, "a")
    spark.range(3).write.parquet(path)
    shared.clear(spark)
    assert not os.path.exists(path) and not os.path.exists(os.path.dirname(path))
