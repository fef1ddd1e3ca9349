"""Scores: weighted penalties, plain deductions, bands and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.schema import CONTRACT, DEFAULT_PENALTY, DIMENSION, DIMENSION_WEIGHT, PENALTY, level_class, lookup, rule_class, scale


def penalty(kind: Column, level: Column) -> Column:
    """Points off for a finding of a class and level; suggestions cost nothing."""
    flat = {f"{k}/{lv}": v for k, by in PENALTY.items() for lv, v in by.items()}
    points = F.coalesce(lookup(flat, F.concat_ws("/", kind, level)), lookup(DEFAULT_PENALTY, level))
    return F.when(level == "info", F.lit(0)).otherwise(points)


def classified(findings: DataFrame) -> DataFrame:
    """findings (rule_id, category, level) with kind, class of level, dimension and points."""
    out = findings.withColumn("kind", rule_class(F.col("rule_id"), F.col("category"))).withColumn("level_class", level_class(F.col("level")))
    return out.withColumn("dimension", lookup(DIMENSION, F.col("kind"))).withColumn("points", penalty(F.col("kind"), F.col("level_class")))


def weighted(findings: DataFrame, *keys: str) -> DataFrame:
    """By keys: bug, code_smell and engineering_maturity (0 to 100 each) and their weighted total, cut to whole points."""
    sums = classified(findings).groupBy(*keys).agg(*(F.sum(F.when(F.col("dimension") == d, F.col("points")).otherwise(0)).alias(f"_{d}") for d in DIMENSION_WEIGHT))
    dims = {d: F.greatest(F.lit(0), (F.lit(100) - F.col(f"_{d}")).cast("int")) for d in DIMENSION_WEIGHT}
    out = sums.select(*keys, *(c.alias(d) for d, c in dims.items()))
    tenths = sum((F.col(d) * int(w * 10) for d, w in DIMENSION_WEIGHT.items()), F.lit(0))  # in tenths, as sums of fractions may fall short
    return out.withColumn("total", F.floor(tenths / 10).cast("int"))


def deduction(counts: dict[str, Column], points: dict[str, float]) -> Column:
    """100 less the points, halves rounded to even, not under 0."""
    off = sum((counts[k] * F.lit(float(points[k])) for k in points), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), 100 - off)).cast("int")


def band(score: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    """The name of the first bound that a score reaches."""
    out = F.lit(last)
    for least, name in reversed(bounds):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


# Grades and levels by score.
GRADES = ([(90, "excellent"), (75, "good"), (60, "fair"), (40, "needs work")], "severe")
LEVELS = ([(90, "excellent"), (70, "good"), (50, "needs work"), (30, "serious")], "critical")
# Points off by level in the plain scores.
PLAIN = {"error": 5.0, "warning": 2.0, "info": 0.5}
ENGINE_POINTS = {1: {"error": 10, "warning": 5, "info": 1}, 2: {"blocker": 10, "high": 10, "medium": 5, "low": 1}, 3: {"blocker": 15, "high": 8, "medium": 3, "low": 1}}


def contract_threshold(engine: int, files: Column) -> Column:
    size = scale(files)
    return F.coalesce(lookup({s: by.get(engine, 0.6) for s, by in CONTRACT.items()}, size), F.lit(0.6))


def mean_engine_score(runs: DataFrame) -> DataFrame:
    """The mean score, cut to whole points, of engine runs that did not fail."""
    good = runs.where("status <> 'error'")
    return good.agg(F.floor(F.coalesce(F.sum("score"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("score"))
