"""State between runs: what changed, what is still valid, what is evicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column, size: Column, whole: int = 1 << 20, edge: int = 1 << 16) -> Column:
    """12 hex digits of the MD5 of a content, or of its size and both ends if it is long."""
    ends = F.concat(size.cast("string"), F.substring(content, 1, edge), F.expr("''") if edge <= 0 else F.substring(content, -edge, edge))
    return F.substring(F.md5(F.when(size <= whole, content).otherwise(ends)), 1, 12)


#: Rows that one task of a join by keys sorts.
TASK_ROWS = 1 << 17


def dealt(rows: DataFrame, key: str, many: DataFrame | None = None) -> DataFrame:
    """rows by key in as many partitions as their number, or that of many, asks for, which joins by the key keep: a task's
    memory does not grow with the table. Of a semi join deal the right side; Spark moves the join below the left one's."""
    return rows.repartition((rows if many is None else many).count() // TASK_ROWS + 1, key)


def diff(current: DataFrame, state: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, status (added, changed, deleted, unchanged) of the keys of either side; compare: columns that make a change."""
    a = dealt(current, key).select(key, F.struct(*compare).alias("_new"), F.lit(True).alias("_a"))
    b = state.select(key, F.struct(*compare).alias("_old"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def diff_two_step(current: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """As diff, but a file whose hash is the same is only touched, whatever its mtime; needs mtime and hash."""
    a = current.select(key, F.col("mtime").alias("_m"), F.col("hash").alias("_h"), F.lit(True).alias("_a"))
    b = state.select(key, F.col("mtime").alias("_om"), F.col("hash").alias("_oh"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_m").eqNullSafe(F.col("_om")), "unchanged").when(F.col("_h").eqNullSafe(F.col("_oh")), "touched").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge_cached(fresh: DataFrame, cached: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Fresh findings, and cached ones of what is unchanged or touched."""
    valid = status.where(F.col("status").isin("unchanged", "touched")).select(key)
    return fresh.unionByName(cached.join(valid, key, "left_semi"), allowMissingColumns=True)


def expired(entries: DataFrame, created: str, now: Column, days: float) -> DataFrame:
    """entries with expired: whether they are older than days."""
    return entries.withColumn("expired", F.col(created).cast("timestamp") < now.cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days * 86400))))


def evict(entries: DataFrame, accessed: str, ties: str, capacity: int, keep_share: float = 0.9) -> DataFrame:
    """entries with kept: all if they fit; else the latest accessed keep_share of the capacity.

    The rank is taken in two steps, of distinct access times first, so that the entries are not sorted in one task."""
    total = entries.agg(F.count(F.lit(1)).alias("_n"))
    per = entries.groupBy(accessed).agg(F.count(F.lit(1)).alias("_k"))
    before = per.withColumn("_before", F.sum("_k").over(Window.orderBy(F.desc(accessed))) - F.col("_k")).drop("_k")
    w = Window.partitionBy(accessed).orderBy(ties)
    ranked = entries.join(before, accessed).withColumn("_r", F.col("_before") + F.row_number().over(w)).crossJoin(F.broadcast(total))
    return ranked.withColumn("kept", (F.col("_n") <= capacity) | (F.col("_r") <= int(capacity * keep_share))).drop("_before", "_r", "_n")


def budget(groups: DataFrame, order: list[Column], size: str, capacity: int) -> DataFrame:
    """groups with kept: those whose running size, in order, stays within the capacity."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("kept", F.sum(size).over(w) <= capacity)


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return planned.select(key).distinct().join(done.select(key), key, "left_anti")


def hunk_lines(diff_text: DataFrame, path: str = "path", text: str = "diff") -> DataFrame:
    """path, new_line, line: the added lines of unified diffs with their numbers in the new file."""
    from sieveworks.functions.text import to_lines

    lines = to_lines(diff_text, path, text)
    w = Window.partitionBy(path).orderBy("line_no")
    head = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    lines = lines.withColumn("start", F.when(head != "", head.cast("int"))).withColumn("hunk", F.sum(F.when(head != "", 1).otherwise(0)).over(w))
    lines = lines.where("hunk > 0")
    own = Window.partitionBy(path, "hunk").orderBy("line_no")
    # lines of the new file so far in this hunk: all but the header and what is taken away
    new = F.sum(F.when(F.col("start").isNotNull() | F.col("line").startswith("-") | F.col("line").startswith("\\"), 0).otherwise(1)).over(own)
    lines = lines.withColumn("new_line", F.first("start").over(own) + new - 1)
    return lines.where(F.col("line").startswith("+")).select(F.col(path).alias("path"), "new_line", F.expr("substring(line, 2)").alias("line"))


def on_added_lines(findings: DataFrame, added: DataFrame) -> DataFrame:
    return findings.join(added.select(F.col("path").alias("file"), F.col("new_line").alias("line")), ["file", "line"], "left_semi")
