import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm import decontam, rules, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == list(cp.COLUMNS)


def test_run_equals_the_stages_and_leaves_nothing_to_do(spark, tmp_path):
    out = cp.run(spark, DATA).collect()
    assert out and len({r["doc_id"] for r in out}) == len(out)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in out}
    assert decontam.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert simhash.near_duplicates(docs).where("doc_id != component_id").count() == 0
    first = spark.read.parquet(str(tmp_path / "0"))
    assert rules.quality_measures(first).where("NOT kept").count() == 0


@pytest.mark.parametrize("k", range(4))
def test_messy_stages(spark, messy, nothing, k):
    stage = cp.STAGES[k][1]
    assert set(stage(spark, messy.drop("lines_removed"), DATA).columns) == set(messy.columns) - {"lines_removed"}
    stage(spark, messy, DATA).count()
    assert stage(spark, nothing, DATA).count() == 0


def test_line_dedup_drops_only_documents_that_lose_everything(spark):
    line = "a line of forty characters or more that both documents share"
    docs = spark.createDataFrame([(1, line, "en", "s", 1), (2, line, "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (5, line + "\nx", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.line_dedup(spark, docs, DATA).collect()}
    assert got == {1: (line, 1), 3: ("", 0), 4: (None, 0), 5: ("x", 1)}


def test_last_stage(spark, messy):
    out = cp.mix_sources(spark, messy, DATA)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert out.agg(F.count("*")).first()[0] == messy.count()
