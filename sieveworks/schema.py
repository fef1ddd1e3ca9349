"""Row types and the small dimensions that every operator shares."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILES = struct(path=_S, rel=_S, basename=_S, ext=_S, size=_L, mtime=T.TimestampType(), content=_S)
RULES = struct(check_id=_S, name=_S, level=_S, severity=_S, category=_S, file_pattern=_S, pattern=_S, suggestion=_S, references=T.ArrayType(_S), module_id=_S, source_dir=_S, rule_type=_S, applicable_types=T.ArrayType(_S))
LOCATION = struct(file=_S, line=_I, column=_I, snippet=_S)
FINDINGS = struct(rule_id=_S, rule_name=_S, level=_S, message=_S, detail=_S, fix=_S, location=LOCATION, category=_S, status=_S, fp_reason=_S, suggestion_code=_S)
ISSUES = struct(engine=_S, check_id=_S, name=_S, severity=_S, file=_S, line=_I, message=_S, suggestion=_S, cwe_id=_S)

# Ranks of severities, the larger the worse; names not listed rank 0.
SEVERITY_RANK = {"blocker": 4, "critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0, "S1": 4, "S2": 3, "S3": 2, "S4": 1}
# Places of severities in an ascending sort; names not listed come last, at 99.
SEVERITY_PLACE = {"blocker": 0, "critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4, "S1": 0, "S2": 1, "S3": 2, "S4": 3}
# One spelling for each severity.
SEVERITY_NAME = {"S1": "blocker", "S2": "high", "S3": "medium", "S4": "low", "critical": "blocker"}
# Levels as error, warning or info; levels not listed are warnings.
LEVEL_CLASS = {"blocking": "error", "problem": "warning", "suggestion": "info", "error": "error", "warning": "warning", "info": "info"}
# Rule severity to finding level.
SEVERITY_LEVEL = {"blocker": "blocking", "critical": "blocking", "high": "problem", "medium": "problem", "low": "suggestion", "info": "suggestion"}
# Engines by precision, the smaller the better; others 99.
ENGINE_PRIORITY = {"semgrep": 1, "rule": 2, "ai": 3}
# Rule sources by precision; others 99.
SOURCE_PRIORITY = {"security": 1, "js_ts": 2, "python_deep": 2, "miniprogram": 2, "performance": 3}
# Confidences in order; others 3.
CONFIDENCE_PLACE = {"high": 0, "medium": 1, "low": 2}
# Lines by which two findings of a category may lie apart and be the same.
TOLERANCE = {"security": 1, "performance": 5}
DEFAULT_TOLERANCE = 3
# Points off by class and level of a finding, and for classes not listed.
PENALTY = {"security": {"error": 40, "warning": 15, "info": 5}, "logic_bug": {"error": 25, "warning": 8, "info": 3}, "convention": {"error": 12, "warning": 5, "info": 2}, "engineering_maturity": {"error": 20, "warning": 8, "info": 2}}
DEFAULT_PENALTY = {"error": 15, "warning": 6, "info": 2}
# The dimension of the score that a class counts for, and the dimensions' weights.
DIMENSION = {"security": "bug", "logic_bug": "bug", "convention": "code_smell", "engineering_maturity": "engineering_maturity"}
DIMENSION_WEIGHT = {"bug": 0.6, "code_smell": 0.3, "engineering_maturity": 0.1}
# Classes by category.
CATEGORY_CLASS = {"security": "security", "wxml": "logic_bug", "ai_specific": "logic_bug", "ai_code_check": "logic_bug", "performance": "logic_bug", "miniprogram_config": "convention", "architecture": "convention", "code_quality": "convention", "engineering": "convention"}
# Classes by rule id, whole or as a prefix.
RULE_CLASS = {"SEC-": "security", "LLM-SEC-": "security", "SKILL-SEC-": "security", "3.": "security", "19.1": "security", "19.2": "security", "19.3": "security", "MP-001": "logic_bug", "MP-004": "logic_bug", "AI-SPEC-01": "logic_bug", "AI-SPEC-02": "logic_bug", "1.": "logic_bug", "2.": "logic_bug", "4.": "logic_bug", "7.": "logic_bug", "8.": "logic_bug", "10.": "logic_bug", "12.": "logic_bug", "13.": "logic_bug", "18.": "logic_bug", "19.4": "logic_bug", "19.5": "logic_bug", "MP-002": "convention", "MP-003": "convention", "MP-005": "convention", "AI-SPEC-03": "convention", "AI-SPEC-04": "convention", "5.": "convention", "6.": "convention", "9.": "convention", "11.": "convention", "15.": "convention", "16.": "convention", "17.": "convention"}
# Quality an engine has to reach, by size of the corpus (under 50 files, up to 200, more).
CONTRACT = {"small": {1: 0.7, 2: 0.75, 3: 0.7, 4: 0.7, 5: 0.6, 6: 0.5, 7: 0.65}, "medium": {1: 0.65, 2: 0.7, 3: 0.65, 4: 0.65, 5: 0.55, 6: 0.45, 7: 0.6}, "large": {1: 0.6, 2: 0.65, 3: 0.6, 4: 0.6, 5: 0.5, 6: 0.4, 7: 0.55}}


def lookup(values: dict, key: Column, default=None) -> Column:
    """values[key], or default where key is null or not listed."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))
    return F.coalesce(F.element_at(table, key), F.lit(default)) if default is not None else F.element_at(table, key)


def severity_rank(col: Column) -> Column:
    return lookup(SEVERITY_RANK, col, 0)


def severity_place(col: Column) -> Column:
    return lookup(SEVERITY_PLACE, col, 99)


def severity_name(col: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_NAME, col), col)


def level_class(col: Column) -> Column:
    return lookup(LEVEL_CLASS, col, "warning")


def tolerance(category: Column) -> Column:
    """By the first listed word that the category contains, whatever its case."""
    out = F.lit(DEFAULT_TOLERANCE)
    for word, lines in reversed(TOLERANCE.items()):
        out = F.when(F.lower(category).contains(word), F.lit(lines)).otherwise(out)
    return out


def scale(files: Column) -> Column:
    return F.when(files < 50, "small").when(files <= 200, "medium").otherwise("large")


def rule_class(rule_id: Column, category: Column) -> Column:
    """The whole id first, then the category, then the first listed prefix, else convention."""
    by_prefix = F.lit("convention")
    for prefix, name in reversed(RULE_CLASS.items()):
        by_prefix = F.when(rule_id.startswith(prefix), F.lit(name)).otherwise(by_prefix)
    return F.coalesce(lookup(RULE_CLASS, rule_id), lookup(CATEGORY_CLASS, category), by_prefix)
