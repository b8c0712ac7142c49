"""Names of file families, against a plain run through the files."""

import random

from turnwise.operators import names


def plain(rows, taken):
    taken, out = set(taken), {}
    for key, stem in sorted(rows):
        k, name = 1, stem
        while name in taken:
            k += 1
            name = f"{stem} ({k})"
        taken.add(name)
        out[key] = name
    return out


def found(spark, rows, taken):
    files = spark.createDataFrame([(k, s, "n", 1) for k, s in rows], "id long, stem string, name string, _root int")
    got = names.unique_names(files.drop("_root"), "id", spark.createDataFrame([(t,) for t in taken], "name string"))
    return {r.id: r.name for r in got.collect()}


def test_literal_families(spark):
    rows = [(1, "a"), (2, "a (2)"), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "audiencia.01"), (8, "a (2)"), (9, "c"), (10, "c (1)"), (11, "c (02)"), (12, "c")]
    want = {1: "a", 2: "a (2)", 3: "a (3)", 4: "a (4)", 5: "b (2)", 6: "b (4)", 7: "audiencia.01", 8: "a (2) (2)", 9: "c", 10: "c (1)", 11: "c (02)", 12: "c (2)"}
    assert plain(rows, ["b", "b (3)"]) == want == found(spark, rows, ["b", "b (3)", "b", None, "z"])


def test_families_against_a_plain_run(spark):
    at = random.Random(2)
    for seed in range(6):
        rows = [(k, at.choice("abc") + at.choice(["", "", " (2)", " (3)", " (2) (2)", " (10)", " x"])) for k in range(150)]
        taken = [at.choice("abcd") + at.choice(["", " (2)", " (4)", " (2) (3)"]) for _ in range(seed)]
        assert found(spark, rows, taken) == plain(rows, taken)


def test_no_files(spark):
    assert found(spark, [], ["a"]) == {} and found(spark, [(1, "a")], []) == {1: "a"}
