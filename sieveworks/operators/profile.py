"""What a corpus is: sizes, ratios, maturity, kind of project, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.text import is_comment, to_lines


def ratios(files: DataFrame, path: str, content: str, *keys: str) -> DataFrame:
    """By keys: files, lines, code and comment lines, open tasks, comment ratio and tasks per thousand code lines."""
    lines = to_lines(files, path, content, *(k for k in keys if k != path)).withColumn("t", F.trim("line"))
    blank, note = F.col("t") == "", is_comment(F.col("line"))
    n = lambda c: F.count(F.when(c, 1))
    out = lines.groupBy(*keys).agg(F.countDistinct(path).alias("files"), F.count(F.lit(1)).alias("lines"), n(~blank & ~note).alias("code_lines"), n(~blank & note).alias("comment_lines"), n(F.col("line").rlike(r"\b(TODO|FIXME|HACK|XXX)\b")).alias("tasks"))
    return out.withColumn("comment_ratio", F.col("comment_lines") / F.greatest(F.lit(1), F.col("code_lines") + F.col("comment_lines"))).withColumn("task_density", F.col("tasks") * 1000.0 / F.greatest(F.lit(1), F.col("code_lines")))


def early_score(density: Column, comments: Column, code: Column, commits: Column, small: Column) -> Column:
    """0 to 6: how much speaks for an early project."""
    return F.when(density > 5, 2).when(density > 2, 1).otherwise(0) + F.when(comments > 0.25, 1).otherwise(0) + F.when((code < 3000) & (commits < 20), 2).when((code < 8000) & (commits < 50), 1).otherwise(0) + F.when(small, 1).otherwise(0)


def stage(score: Column, code: Column) -> Column:
    return F.when((score >= 3) & (code < 10000), "early").otherwise("mature")


# By how much thresholds are raised for early projects.
EARLY_FACTORS = {"function_lines": 1.5, "cyclomatic_complexity": 1.67, "duplicate_similarity": 1.125, "hardcoded_color_density": 2.0}


def threshold(stage_name: Column, rule: str, value: float) -> Column:
    factor = EARLY_FACTORS.get(rule)
    return F.lit(value) if factor is None else F.when(stage_name == "mature", F.lit(value)).otherwise(F.lit(int(value * factor)))


def project_flags(files: DataFrame) -> DataFrame:
    """One row of flags about a corpus (files: basename, content)."""
    b, c = F.col("basename"), F.coalesce(F.col("content"), F.lit(""))
    py = b.endswith(".py")
    has = {
        "wxml": b.endswith(".wxml"),
        "component": b.endswith(".vue") | b.endswith(".tsx") | b.endswith(".jsx"),
        "html": b.endswith(".html") | b.endswith(".htm"),
        "py": py,
        "flask": py & c.rlike(r"(?m)^\s*(?:from|import)\s+flask\b"),
        "django": py & c.rlike(r"(?m)^\s*(?:from|import)\s+django\b"),
        "fastapi": py & c.rlike(r"(?m)^\s*(?:from|import)\s+fastapi\b"),
        "server": py & c.rlike(r"uvicorn\.run|app\.run\(|serve_forever|HTTPServer"),
        "cli": py & c.rlike(r"argparse|import click|sys\.argv"),
        "skill": b == "SKILL.md",
        "app_pages": (b == "app.json") & c.contains('"pages"'),
        "electron": (b == "package.json") & c.rlike(r'"electron"\s*:') | b.isin("main.js", "main.ts", "electron.js", "electron.ts") & c.rlike(r"""require\(['"]electron['"]\)|from ['"]electron['"]"""),
        "frontend_dep": (b == "package.json") & c.rlike(r'"(?:react|vue|@angular/core|svelte)"\s*:'),
    }
    return files.agg(*(F.coalesce(F.bool_or(v), F.lit(False)).alias(k) for k, v in has.items()))


def project_type() -> Column:
    """The kind of project that a row of flags tells: apps by their marks first, then back end, front end, tool."""
    f = F.col
    backend, front = f("flask") | f("django") | f("fastapi"), f("component") | f("wxml") | f("frontend_dep")
    python = F.when(f("flask"), "flask").when(f("server") & ~f("cli") | backend, "python_backend").otherwise("python_tool")
    return (
        F.when(f("skill"), "skill")
        .when(f("wxml") & f("app_pages"), F.when(f("py"), "mixed").otherwise("miniprogram"))
        .when(f("electron"), F.when(f("py"), "mixed_electron").otherwise("electron"))
        .when(front & f("py"), "mixed")
        .when(front, "web")
        .when(f("html") & backend, F.when(f("flask"), "flask").otherwise("python_backend"))
        .when(f("html") & f("py"), F.lit("python_backend"))
        .when(f("html"), "web")
        .when(f("py"), python)
        .otherwise("unknown")
    )


def framework_scores(files: DataFrame, signatures: DataFrame, dependencies: DataFrame) -> DataFrame:
    """framework, type, score of frameworks over 0.3: the share of the points for a named file (50), extensions (2 each, 20 at
    most), imports (5 each, 30 at most) and a dependency (20), times the framework's weight.

    signatures: framework, type, weight, kind (file, ext, import, dep), word."""
    words = F.broadcast(signatures)
    b, c = F.lower("basename"), F.col("content")
    test = F.when(F.col("kind") == "file", F.endswith(b, F.lower("word"))).when(F.col("kind") == "ext", F.endswith(b, F.lower("word"))).when(F.col("kind") == "import", F.expr("content rlike word"))
    hits = files.select("basename", "content").join(words.where("kind <> 'dep'"), test).groupBy("framework", "kind").agg(F.count(F.lit(1)).alias("n"))
    deps = signatures.where("kind = 'dep'").join(dependencies.select(F.lower("name").alias("_d")).distinct(), F.lower("word") == F.col("_d")).groupBy("framework", "kind").agg(F.count(F.lit(1)).alias("n"))
    points = F.when(F.col("kind") == "file", 50).when(F.col("kind") == "ext", F.least(F.lit(20), F.col("n") * 2)).when(F.col("kind") == "import", F.least(F.lit(30), F.col("n") * 5)).otherwise(20)
    most = F.when(F.col("kind") == "file", 50).when(F.col("kind") == "ext", 20).when(F.col("kind") == "import", 30).otherwise(20)
    got = hits.unionByName(deps).withColumn("p", points).groupBy("framework").agg(F.sum("p").alias("got"))
    full = signatures.select("framework", "type", "weight", "kind").distinct().withColumn("m", most).groupBy("framework", "type", "weight").agg(F.sum("m").alias("full"))
    return full.join(got, "framework").withColumn("score", F.col("got") / F.col("full") * F.col("weight")).where("score > 0.3").select("framework", "type", "score")


def best_per_type(scores: DataFrame) -> DataFrame:
    return scores.groupBy("type").agg(F.max_by("framework", F.struct("score", "framework")).alias("framework"), F.max("score").alias("score"))
