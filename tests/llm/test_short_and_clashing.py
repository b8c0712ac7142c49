"""Short benchmark items, and input columns named as the operators' own helpers."""

from pyspark.sql import functions as F

from turnwise.llm import decontamination, mixing, ngram_join, sharding

NAMES = "_row _id _of _source _cdf _parts _count _bad _gone_id _twice_id _jump _bucket _place _shard _before _order slot shard".split()
TEXTS = ["one two three four five six seven eight nine ten"] * 40 + ["a b c d e f g h i j k l", None, ""]


def clashing(spark):
    return spark.createDataFrame([(None if i == 42 else i % 41, t, "en", "s", *range(len(NAMES))) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in NAMES))


def test_helper_columns_may_clash(spark):
    docs, bench = clashing(spark), spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert mixing.mix(docs, size=3.0).columns[:-2] == docs.columns
    assert decontamination.clean(docs, bench).columns == docs.columns and decontamination.clean(docs, bench).count() == len(TEXTS) - 1
    assert ngram_join.one_of_each(docs).columns == docs.columns
    slots = sharding.with_slots(sharding.shard_rows(docs, 3), "shard", ["doc_id"], shuffled=True)
    assert set(slots.columns) == {*docs.columns, "grown_shard"}
    for s in {r.shard for r in slots.select("shard").collect()}:
        assert sorted(r.slot for r in slots.where(F.col("shard") == s).select("slot").collect()) == list(range(slots.where(F.col("shard") == s).count()))


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (4, None), (4, None), (5, a), (5, a), (None, a)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("1", a), ("2", b), ("4", "None"), ("4", "None"), ("None", a)])


def test_short_items_are_sought_whole(spark):
    docs = spark.createDataFrame([(1, "He said: one, two three four five six SEVEN!"), (2, "one two three four five six"), (3, "yes or no"), (4, "is it yes or no then"), (5, "aa bb cc dd ee"), (6, ""), (7, "or no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "Yes or no?"), (3, "AA bb cc dd ee"), (4, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)}
