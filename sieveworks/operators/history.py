"""What runs leave behind: trends, engine scores and routes, a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of an engine's parts, and of what makes two tasks similar.
ENGINE_WEIGHTS = {"effectiveness": 0.35, "efficiency": 0.25, "reliability": 0.25, "cost_efficiency": 0.15}
TASK_WEIGHTS = {"task_type": 3.0, "complexity": 2.0, "file_count": 1.5, "languages": 1.5, "framework": 1.0}
LONGEST_S, COST_FACTOR = 180.0, 50.0


def trend(series: DataFrame, keys: list[str], when: str, *values: str) -> DataFrame:
    """series with the change of each value since the row before."""
    w = Window.partitionBy(*keys).orderBy(when)
    return series.withColumns({f"{v}_change": F.col(v) - F.lag(v).over(w) for v in values})


def first_to_last(series: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """keys, first, last, change and direction (improving if it falls)."""
    out = series.groupBy(*keys).agg(F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last"))
    change = F.col("last") - F.col("first")
    return out.withColumn("change", change).withColumn("direction", F.when(change < 0, "improving").when(change > 0, "degrading").otherwise("stable"))


def latest(series: DataFrame, keys: list[str], when: str, n: int) -> DataFrame:
    """The latest n rows of each key; ties by all other columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc(when), *(c for c in series.columns if c != when))
    return series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def engine_scores(runs: DataFrame, *keys: str) -> DataFrame:
    """runs (accuracy, elapsed, fp_rate, cost) to effectiveness, efficiency, reliability, cost_efficiency and composite."""
    out = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg("accuracy").alias("effectiveness"), F.avg("elapsed").alias("_t"), F.avg("fp_rate").alias("_f"), F.avg("cost").alias("_c"))
    out = out.withColumn("efficiency", F.col("effectiveness") * F.greatest(F.lit(0.0), 1 - F.col("_t") / LONGEST_S)).withColumn("reliability", 1 - F.col("_f"))
    out = out.withColumn("cost_efficiency", F.when(F.col("_c") > 0, F.col("effectiveness") / (1 + F.col("_c") * COST_FACTOR)).otherwise(F.col("effectiveness")))
    return out.withColumn("composite", sum((F.col(k) * w for k, w in ENGINE_WEIGHTS.items()), F.lit(0.0))).drop("_t", "_f", "_c")


def task_similarity(other: str = "q_") -> Column:
    """Similarity of a row's task to that in the columns with a prefix; parts that either lacks do not count."""
    mine, theirs = (lambda c: F.col(c)), (lambda c: F.col(other + c))
    known, got = F.lit(0.0), F.lit(0.0)
    for c, w in TASK_WEIGHTS.items():
        if c == "file_count":
            both = (mine(c) > 0) & (theirs(c) > 0)
            part = F.least(mine(c), theirs(c)) / F.greatest(mine(c), theirs(c))
        elif c == "languages":
            both = (F.size(mine(c)) > 0) & (F.size(theirs(c)) > 0)
            part = F.size(F.array_intersect(mine(c), theirs(c))) / F.size(F.array_union(mine(c), theirs(c)))
        else:
            both = (mine(c) != "") & (theirs(c) != "")
            part = F.when(mine(c) == theirs(c), 1.0).otherwise(0.0)
        known = known + F.when(both, F.lit(w)).otherwise(0.0)
        got = got + F.when(both, part * w).otherwise(0.0)
    return F.when(known > 0, got / known).otherwise(0.0)


def nearest(history: DataFrame, task: DataFrame, k: int = 20, least: float = 0.1) -> DataFrame:
    """The k rows of history most similar to the one row of task (its columns), by similarity and then by all columns."""
    query = task.select(*(F.col(c).alias(f"q_{c}") for c in TASK_WEIGHTS))
    scored = history.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", task_similarity()).drop(*(f"q_{c}" for c in TASK_WEIGHTS))
    return scored.where(F.col("similarity") > least).orderBy(F.desc("similarity"), "task_id").limit(k)


def route(similar: DataFrame, enough: int = 3, least_accuracy: float = 0.5) -> DataFrame:
    """engine, accuracy, n of engines that did well on similar tasks; empty if there are too few to tell."""
    n = similar.agg(F.count(F.lit(1)).alias("_n"))
    out = similar.groupBy("engine").agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return out.crossJoin(F.broadcast(n)).where((F.col("_n") >= enough) & (F.col("accuracy") >= least_accuracy)).drop("_n")


def within_budget(candidates: list[tuple[str, float]], budget: float) -> list[str]:
    """Engines (name, cost) by rising cost, those skipped that no longer fit."""
    chosen, left = [], budget
    for name, cost in sorted(candidates, key=lambda c: (c[1], c[0])):
        if cost <= left:
            chosen.append(name)
            left -= cost
    return chosen


def upsert_patterns(known: DataFrame | None, seen: DataFrame) -> DataFrame:
    """pattern_id, occurrence_count, first_seen, last_seen, projects, example: known patterns with what was seen added.

    seen: pattern_id, seen_at, project, example; known as this returns it."""
    new = seen.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.array_sort(F.collect_set("project")).alias("projects"), F.max_by("example", F.struct("seen_at", "example")).alias("example"))
    if known is None:
        return new
    both = known.unionByName(new)
    return both.groupBy("pattern_id").agg(F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("projects")))).alias("projects"), F.max_by("example", F.struct("last_seen", "example")).alias("example"))


def suggestions(patterns: DataFrame, often: int = 5) -> DataFrame:
    """pattern_id, kind, confidence: patterns seen often are worth a rule, and the more the surer."""
    return patterns.where(F.col("occurrence_count") >= often).select("pattern_id", F.lit("new_rule").alias("kind"), F.least(F.lit(1.0), F.col("occurrence_count") / F.lit(2.0 * often)).alias("confidence"))
