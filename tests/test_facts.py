"""Facts at size: small tables are dealt out, texts are read once, and the results stay the same."""

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import crossfile as C
from sieveworks.operators import facts as A

TEXT = "import os, json\nwith open('a') as f:\n    g = open('b')\nh = open('c')\ntry:\n    k = open('d')\nfinally:\n    os.x\nfor r in h:\n    c.execute(r)\n"


@pytest.fixture
def files(spark):
    rows = [(f"f{i}", TEXT if i % 2 else TEXT.replace("os.x", "json")) for i in range(60)] + [(None, TEXT), ("e", None), ("bad", "(")]
    return spark.createDataFrame(rows, "path string, content string").coalesce(1)


def reads(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n\n")[0].count("MapInArrow")


def test_files_of_one_partition_are_parsed_in_several_tasks(files, monkeypatch):
    monkeypatch.setattr(A, "TASK_BYTES", 1000)
    monkeypatch.setattr(A, "BATCH_FACTS", 7)
    facts = A.python_facts(files)
    assert facts.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    every = sorted(map(str, ((r["path"], *f) for r in files.collect() for f in A.python_facts_of(r["content"] or ""))))
    assert sorted(str(tuple(r)) for r in facts.collect()) == every
    assert sorted(str(tuple(r)) for r in A.python_facts(files, kinds=("call",)).collect()) == [x for x in every if x.split(", ")[1] == "'call'"]


def test_unclosed_reads_facts_once(files):
    out = A.unclosed(A.python_facts(files), ["open"])
    assert reads(out) == 1
    assert sorted(map(str, out.collect())) == sorted([f"Row(path='f{i}', line=4, name='open')" for i in range(60)] + [f"Row(path=None, line={k}, name='open')" for k in (2, 3, 4, 6)])


def test_unused_imports_leave_other_words_in_their_file(files):
    out = A.unused_imports(A.python_facts(files, kinds=("import",)), files)
    assert {(r["path"], r["name"]) for r in out.collect()} == {(f"f{i}", "json" if i % 2 else "os") for i in range(60)}


def test_shared_names(spark):
    rows = [("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("b", None), (None, "1"), (None, "3")]
    out = C.shared_names(spark.createDataFrame(rows, "name string, path string"))
    assert {(r["name"], r["files"], tuple(r["paths"])) for r in out.collect()} == {("a", 2, ("1", "2")), (None, 2, ("1", "3"))}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString() and "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
