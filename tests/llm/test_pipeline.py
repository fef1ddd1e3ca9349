import os

import pytest

import corpus_pipeline
from sieveworks.llm import decontam, pii, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.leaks(docs, bench).count() == 0
    assert all(not [s for s in pii.find(r["text"]) if s[2] in pii.BASE] for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns[: len(columns)] == columns and last.count() == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert [r["mix_position"] for r in rows] == list(range(len(rows)))


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "word " * 30_000, "en", "a", 150_000), (2, "word " * 30_000, "en", "a", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
