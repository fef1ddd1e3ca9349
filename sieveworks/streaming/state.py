"""Incremental scans as streams, and windows over finding streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators.scan import Rule, evaluate


class KeyedState:
    """Versions of a small-per-key state table in one folder; the highest finished version counts.

    A version is written whole before its number is, so that a run that dies leaves the last one valid."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(self.root)
        if not self._fs.exists(at):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(at))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The highest version, of those under before if it is given: a repeated batch starts from what it started from at first."""
        got = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v{got[-1]}") if got else None

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/v{version}")


def scan_batch(files: DataFrame, rules: list[Rule], state: KeyedState, cache: KeyedState, version: int, rule_version: str = "") -> DataFrame:
    """Scans the changed files of one batch (path, basename, content) and returns all current findings.

    Unchanged files keep their cached findings; another rule version invalidates them all. The batch's version makes a
    repeated batch write the same state again."""
    current = files.select("path", "basename", "content", F.md5("content").alias("hash"))
    old = state.read(version)
    if old is None:
        changed, kept_state = current, None
    else:
        same = old.where(F.col("rule_version") == rule_version).select("path", "hash")
        changed = current.join(same, ["path", "hash"], "left_anti")
        kept_state = old.join(current.select("path"), "path", "left_anti")
    fresh = evaluate(changed, rules).withColumn("rule_version", F.lit(rule_version))
    cached = cache.read(version)
    if cached is not None:
        stale = changed.select("path")
        fresh = fresh.unionByName(cached.where(F.col("rule_version") == rule_version).join(stale, "path", "left_anti"))
    now = current.select("path", "hash", F.lit(rule_version).alias("rule_version"))
    state.write(now if kept_state is None else now.unionByName(kept_state.select(now.columns)), version)
    cache.write(fresh, version)
    return cache.read()


def scan_stream(files: DataFrame, rules: list[Rule], root: str, rule_version: str = ""):
    """A stream of files (path, basename, content), scanned batch by batch; returns the writer, to be started."""
    spark = files.sparkSession
    state, cache = KeyedState(spark, f"{root}/state"), KeyedState(spark, f"{root}/findings")
    return files.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda batch, number: scan_batch(batch, rules, state, cache, number, rule_version) and None)


def sessions(events: DataFrame, keys: list[str], when: str, gap: str, late: str | None = None) -> DataFrame:
    """keys, start, end, n: runs of events that follow each other within gap; late bounds a stream's state."""
    rows = events.withWatermark(when, late) if late else events
    return rows.groupBy(*keys, F.session_window(when, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counts_per_window(events: DataFrame, when: str, width: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
