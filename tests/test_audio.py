"""Samples and vectors by literal cases and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import audio


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("samples", "channels", "want"), [([16384, -16384], 1, [0.5, -0.5]), ([16384, 0, -32768, 32767, 8192], 2, [0.25, -1 / 65536]), ([3], 2, []), ([], 1, []), ([-32768], 0, [-1.0]), ([32768, 0, 0], 3, [1 / 3])])
def test_downmix(spark, samples, channels, want):
    assert one(spark, (samples, channels), "s array<int>, c int", audio.downmix(F.col("s"), F.col("c"))) == pytest.approx(want)


def test_resample_against_a_loop(spark):
    at = random.Random(1)
    for rate in (8000, 16000, 22050, 44100, 48000, 96000):
        for n in (0, 1, 2, 5, 64):
            x = [at.uniform(-1, 1) for _ in range(n)]
            want, ratio = list(x), 16000 / rate
            if n and rate != 16000:
                want = []
                for i in range(max(1, int(n * ratio))):
                    p = i / ratio
                    a, b = int(p), min(int(p) + 1, n - 1)
                    want.append(x[a] * (1 - (p - a)) + x[b] * (p - a))
            assert one(spark, (x, rate), "s array<double>, r int", audio.resample(F.col("s"), F.col("r"))) == pytest.approx(want)


def test_similarity(spark):
    of = lambda a, b: one(spark, (a, b), "a array<double>, b array<double>", audio.similarity(F.col("a"), F.col("b")))
    assert of([1.0, 0.0], [0.6, 0.8]) == 0.6 and of([2.0], [3.0]) == 1.0 and of([2.0], [-3.0]) == -1.0 and of([1.0], [1.0, 0.0]) is None and of(None, [1.0]) is None and of([1.0], None) is None
