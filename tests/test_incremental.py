"""Joins of states by keys are dealt out by the number of rows."""

from sieveworks.operators import incremental as I


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "TASK_ROWS", 100)
    now, old = spark.range(1000).selectExpr("id", "id % 7 as v"), spark.range(500, 1500).selectExpr("id", "id % 7 + int(id % 5 = 0) as v")
    status = I.diff(now, old, "id", ["v"])
    assert status.rdd.getNumPartitions() == 11
    want = {i: "added" if i < 500 else "deleted" if i >= 1000 else "changed" if i % 5 == 0 else "unchanged" for i in range(1500)}
    assert {r["id"]: r["status"] for r in status.collect()} == want and status.count() == 1500
