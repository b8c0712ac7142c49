"""The pipeline's stages on their own inputs, and the whole against the stages' brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb

import corpus_pipeline
from test_llm import SF, jump, joined, leaked, measured
from turnwise.llm import mixing, quality
from turnwise.llm.common import written


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs, written(stage(spark, docs, SF), name)
        came, went = [(r.doc_id, r.text) for r in before.collect()], out.collect()
        ids = {r.doc_id for r in went}
        assert out.columns[: len(columns)] == columns
        if name == "quality_rules":
            assert ids == {i for i, _ in came if verdict[i]} and all(not measured(r.text)[5] for r in went)
        elif name == "ngram_jaccard_join":
            assert {str(i) for i in ids} == {c for _, _, c in joined(came, 5, 80)}
        elif name == "benchmark_decontamination":
            gone = [(i, t) for i, t in came if i not in ids]
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {d for d, _ in leaked(gone, items)} == {i for i, _ in gone}
        elif name == "source_mixing":
            con = duckdb.connect()
            before.toPandas().to_parquet(tmp_path / "d.parquet")
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / 'd.parquet'}'")
            want = con.execute(f"SELECT doc_id FROM ({mixing.oracle()}) ORDER BY 1").fetchall()
            assert sorted(r.doc_id for r in went) == [i for (i,) in want]
        else:
            assert len(went) == len(came) and all((r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9)) for r in went)
        docs = out
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())
