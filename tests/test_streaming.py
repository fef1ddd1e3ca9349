"""Incremental scans as a stream equal whole scans."""

from sieveworks.operators.scan import Rule, evaluate
from sieveworks.streaming import state as Z

RULES = [Rule("E", r"eval\("), Rule("T", r"TODO")]


def files(spark, **content):
    return spark.createDataFrame([(k, f"{k}.py", v) for k, v in content.items()], "path string, basename string, content string")


def plain(df):
    return sorted((r["path"], r["rule_id"], r["line"]) for r in df.collect())


def test_only_changes_are_scanned_and_the_rest_is_kept(spark, tmp_path):
    state, cache = Z.KeyedState(spark, f"{tmp_path}/s"), Z.KeyedState(spark, f"{tmp_path}/c")
    first = files(spark, a="eval(x)", b="TODO\nTODO", c="")
    assert plain(Z.scan_batch(first, RULES, state, cache, 0)) == plain(evaluate(first, RULES))
    second = files(spark, b="TODO\neval(y)", d="eval(1)")
    whole = files(spark, a="eval(x)", b="TODO\neval(y)", c="", d="eval(1)")
    assert plain(Z.scan_batch(second, RULES, state, cache, 1)) == plain(evaluate(whole, RULES))
    assert plain(Z.scan_batch(second, RULES, state, cache, 1)) == plain(evaluate(whole, RULES))  # a repeated batch
    assert state.read().count() == 4 and state.versions() == [0, 1]


def test_stream_of_files(spark, tmp_path):
    source = str(tmp_path / "in")
    files(spark, a="eval(x)", b="ok").write.parquet(source)
    stream = spark.readStream.schema("path string, basename string, content string").parquet(source)
    q = Z.scan_stream(stream, RULES, str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    files(spark, b="TODO").write.mode("append").parquet(source)
    q = Z.scan_stream(stream, RULES, str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = Z.KeyedState(spark, f"{tmp_path}/out/findings").read()
    assert plain(got) == [("a", "E", 1), ("b", "T", 1)]


def test_windows_with_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 05:00:00", "y")], "ts string, k string").selectExpr("timestamp(ts) ts", "k")
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = Z.counts_per_window(stream, "ts", "1 hour", "30 minutes", "k").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.sql("select * from windows").collect()) == [("x", 2), ("y", 1)]
