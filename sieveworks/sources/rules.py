"""Rule catalogs: JSON rule files below any folder, as a table and as rules that can run."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators.scan import Rule
from sieveworks.schema import SEVERITY_LEVEL, lookup, severity_name

_FIELDS = ["check_id", "id", "name", "level", "severity", "category", "description", "suggestion", "pattern", "detection_pattern", "semgrep_id", "semgrep_rule", "semgrep_rule_id", "file_pattern"]


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of all JSON files below path: lists of rules, or objects with a list under rules. Folders whose names begin
    with an underscore are left out. Missing fields have defaults; a list of files stands for a pattern that is missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    files = files.where(~F.col("path").rlike("/_[^/]*/")).select("path", F.decode("content", "UTF-8").alias("t"))
    kind = "array<struct<" + ",".join(f"{f}:string" for f in _FIELDS) + ",applicable_files:array<string>,references:array<string>,applicable_types:array<string>>>"
    whole = F.when(F.ltrim("t").startswith("["), F.from_json("t", kind)).otherwise(F.from_json("t", f"struct<rules:{kind}>")["rules"])
    rows = files.select("path", F.posexplode(whole).alias("ord", "r")).select("path", "ord", "r.*")
    ident = F.coalesce("check_id", "id")
    level = F.coalesce(F.col("level"), lookup(SEVERITY_LEVEL, severity_name(F.lower(F.coalesce("severity", F.lit("medium"))))), F.lit("problem"))
    pattern = F.coalesce("pattern", F.lit(""))
    out = rows.where(ident.isNotNull()).select(
        ident.alias("check_id"), F.coalesce("name", ident).alias("name"), level.alias("level"), severity_name(F.coalesce("severity", F.lit("medium"))).alias("severity"), F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce(F.when(F.col("file_pattern") != "", F.col("file_pattern")), F.array_join("applicable_files", ","), F.lit("*")).alias("file_pattern"), pattern.alias("pattern"), F.coalesce("suggestion", F.lit("")).alias("suggestion"),
        F.coalesce("references", F.array().cast("array<string>")).alias("references"), F.element_at(F.split("path", "/"), -2).alias("source_dir"), rule_type().alias("rule_type"), F.coalesce("applicable_types", F.array(F.lit("all"))).alias("applicable_types"), "path", "ord",
    )
    return out


def rule_type() -> Column:
    """regex with a pattern; semgrep with a semantic pattern, a name of one or such an id; else semantic."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(filled("pattern"), "regex").when(filled("detection_pattern") | filled("semgrep_id") | filled("semgrep_rule") | filled("semgrep_rule_id") | F.lower(F.coalesce("id", "check_id", F.lit(""))).endswith("-semg"), "semgrep").otherwise("semantic")


def runnable(rules: DataFrame) -> list[Rule]:
    """The regex rules of a catalog; a catalog is a small dimension."""
    return [Rule(r["check_id"], r["pattern"], r["name"], r["level"], r["severity"], r["category"], r["file_pattern"], r["suggestion"]) for r in rules.where("rule_type = 'regex'").orderBy("path", "ord").collect()]


def for_project(rules: DataFrame, project: str) -> DataFrame:
    """Rules for a kind of project; rules for all kinds stay."""
    return rules.where(F.array_contains("applicable_types", "all") | F.array_contains("applicable_types", project) | (F.size("applicable_types") == 0))


def search(rules: DataFrame, word: str = "", severity: str | None = None, category: str | None = None) -> DataFrame:
    out = rules
    if word:
        out = out.where(F.exists(F.array(F.col("check_id"), F.col("name"), F.col("suggestion")), lambda c: F.contains(F.lower(c), F.lit(word.lower()))))
    if severity:
        out = out.where(F.col("severity") == severity)
    return out.where(F.col("category") == category) if category else out


def duplicate_ids(rules: DataFrame) -> DataFrame:
    return rules.groupBy("check_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).where("n > 1")


def silent(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules that no finding names."""
    return rules.join(findings.select(F.col("rule_id").alias("check_id")).distinct(), "check_id", "left_anti")


def version(spark: SparkSession, path: str) -> str:
    """12 hex digits of the names, sizes and times of a catalog's files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path", "length", F.col("modificationTime").cast("long")).orderBy("path").collect()
    return hashlib.md5("|".join(f"{r[0].rsplit('/', 1)[-1]}:{r[1]}:{r[2]}" for r in rows).encode()).hexdigest()[:12]


def snapshot(rules: DataFrame, root: str, mark: str) -> DataFrame:
    """The catalog as Parquet below root/mark, written once for each version."""
    spark = rules.sparkSession
    path = f"{root}/{mark}"
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001  there is none yet
        rules.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
