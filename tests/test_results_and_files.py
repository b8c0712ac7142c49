"""Files as a sink and a source, engine results and saved transcripts, by literal cases."""

import os

import pytest
from pyspark.sql import functions as F

from turnwise.operators import results
from turnwise.sources import files

RAW = [
    (1, ' {"text":"hola \\u00e1 \\"x\\"","segments":[{"startMs":10,"endMs":20,"text":"hola","words":[{"startMs":10,"endMs":null,"text":"ho"},{"text":"la"},7,{"startMs":15,"endMs":20,"text":"!"}]},5,{"text":"b"}]}\n'),
    (2, "__VTT_CANCELLED__ "), (3, "__VTT_ERROR__:no hay memoria"), (4, "__VTT_ERROR__:  "), (5, "{broken"), (6, None), (7, "[1]"), (8, "{}"), (9, '{"text":"t\\n\\t\\u0001","segments":{}}'), (10, '{"segments":null,"text":"\\\\"}'),
]


def test_engine_results(spark):
    got = {r.id: r for r in results.engine_results(spark.createDataFrame(RAW, "id int, raw string")).collect()}
    assert {k: (r.status, r.message) for k, r in got.items() if r.status != "ok"} == {2: ("cancelled", None), 3: ("error", "no hay memoria"), 4: ("error", "Error del motor nativo"), 5: ("corrupt", None), 6: ("corrupt", None), 7: ("corrupt", None)}
    assert got[1].text == 'hola á "x"' and got[1].segments == [(10, 20, "hola", [(10, None, "ho"), (None, None, "la"), (15, 20, "!")]), (0, 0, "b", [])]
    assert (got[8].text, got[8].segments) == ("", []) and (got[9].text, got[9].segments) == ("t\n\t\x01", []) and got[10].text == "\\"
    assert got[3].text is None and got[3].segments is None


def test_engine_json_of_odd_texts_reads_back(spark):
    odd = ['a "quoted" \\ text', "tab\tline\nfeed\rreturn\x01\x1f end", "é 日本 🙂", "</script>", ""]
    segments = spark.createDataFrame([(1, k, 10 * k, 10 * k + 5, t) for k, t in enumerate(odd)], "source_id long, seg_id long, start_ms long, end_ms long, text string")
    words = spark.createDataFrame([(1, 0, 0, 0, 2, "a"), (1, 0, 1, None, None, '"quoted"')], "source_id long, seg_id long, word_idx int, start_ms long, end_ms long, word string")
    row = results.engine_results(results.result_json(segments, words)).first()
    assert row.status == "ok" and [s.text for s in row.segments] == odd and row.segments[0].words == [(0, 2, "a"), (None, None, '"quoted"')] and row.text == " ".join(odd)


def test_saved_transcripts(spark):
    rows = [
        ("a", '{"original":"x","edited":null,"sourceName":"s.wav","language":"es","updatedAt":5,"revision":2,"segments":[{"startMs":1,"endMs":2,"text":"x"}]}'), ("b", '{"original":"","model":"m"}'), ("c", " \n\t"), ("d", None), ("e", "not json"),
        ("f", '{"original":"y","edited":"z","model":"small"}'), ("g", "[]"), ("h", '{"original":"y"'),
    ]
    got = {r.name: r for r in results.saved_transcripts(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "empty", "c": "missing", "d": "missing", "e": "corrupt", "f": "ok", "g": "corrupt", "h": "corrupt"}
    a, f = got["a"], got["f"]
    assert (a.original, a.edited, a.source_name, a.model, a.language, a.updated_at, a.revision, a.segments) == ("x", None, "s.wav", "base", "es", 5, 2, [(1, 2, "x", [])])
    assert (f.edited, f.model, f.language, f.updated_at, f.segments) == ("z", "small", "", 0, [])


def test_files_read_back_equal_what_was_written(spark, tmp_path):
    rows = [("a.txt", "uno\r\ndos\n"), ("b (2).srt", "é 🙂 %2B + ñ"), ("c+d%20.md", ""), ("e.vtt", None), ("audiencia.01.txt", "x\x00y")]
    made = spark.createDataFrame(rows, "name string, text string").repartition(3)
    files.write_files(made, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(n for n, _ in rows)
    assert sorted(map(tuple, files.read_files(spark, str(tmp_path / "out")).collect())) == sorted((n, t or "") for n, t in rows)
    files.write_files(made.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_files(spark.createDataFrame([("a.txt", "first")], "name string, text string"), path)
    broken = spark.range(0, 40, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("t")).alias("text"))
    taken = spark.createDataFrame([("z.txt", "new"), ("a.txt", "second")], "name string, text string")
    twice = spark.createDataFrame([("z.txt", "1"), ("z.txt", "2")], "name string, text string").repartition(2)
    for bad in (broken, taken, twice, spark.createDataFrame([("../x", "t")], "name string, text string")):
        with pytest.raises(Exception):
            files.write_files(bad, path)
        assert os.listdir(path) == ["a.txt"] and (tmp_path / "out" / "a.txt").read_text() == "first"
