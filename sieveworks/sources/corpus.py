"""Corpora and reports: trees of files, manifests, diffs, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.text import split_lines, to_lines

# Directories that are never scanned.
EXCLUDED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode"]
#: A file that says so in its first characters is left out.
EXCLUDE_MARK, MARK_CHARS = "[SCAN_EXCLUDE]", 200
#: A NUL among the first characters makes a file binary.
SNIFF_CHARS = 4096
# Names whose files come first where the number of files is limited.
KEY_NAMES = ["app", "main", "index", "config", "server", "api"]


def read_tree(spark: SparkSession, *roots: str, excluded: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """path, rel, root, basename, ext, size, mtime, content of the text files below the roots. Directories and extensions are
    tested on the path, before any content is decoded."""
    out = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "^/+", "")
        files = files.withColumns({"rel": rel, "root": F.lit(root), "basename": F.substring_index("path", "/", -1)})
        files = files.withColumn("ext", F.lower(F.regexp_extract("basename", r"(\.[^.]+)$", 1)))
        dirs = F.slice(F.split("rel", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("rel", "/")) - 1))
        files = files.where(~F.exists(dirs, lambda d: d.isin(*(EXCLUDED if excluded is None else excluded))))
        if extensions:
            files = files.where(F.col("ext").isin(*extensions))
        out = files if out is None else out.unionByName(files)
    text = out.withColumn("content", F.decode("content", "UTF-8"))
    return readable(text).select("path", "rel", "root", "basename", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def readable(files: DataFrame, content: str = "content") -> DataFrame:
    """files that are text and not marked to be left out."""
    c = F.col(content)
    return files.where(~F.substring(c, 1, MARK_CHARS).contains(EXCLUDE_MARK) & (F.instr(F.substring(c, 1, SNIFF_CHARS), "\0") == 0))


def first_files(files: DataFrame, most: int, name: str = "basename") -> DataFrame:
    """The first files by path, those with key names before others: a limit that is asked for."""
    stem = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.withColumn("_p", (~stem.isin(*KEY_NAMES)).cast("int")).orderBy("_p", "path").limit(most).drop("_p")


def joined_content(files: DataFrame, path: str = "path", content: str = "content", *keys: str) -> DataFrame:
    """By keys: all contents in the order of their paths."""
    return files.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, content))), lambda x: x[content]), "\n").alias("content"))


def requirements(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, name, spec, pinned of a requirements list; comments, options and empty lines are left out."""
    lines = to_lines(files, path, content).withColumn("line", F.trim(F.regexp_replace("line", r"\s+#.*$", ""))).where(~F.col("line").rlike(r"^($|#|-)"))
    name = F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return lines.select(F.col(path).alias("path"), "line_no", name.alias("name"), F.regexp_extract("line", r"^[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?\s*(.*)$", 1).alias("spec"), F.col("line").rlike(r"==|>=|<=|~=").alias("pinned")).where("name <> ''")


def package_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, section, name, version of a package description in JSON."""
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    parsed = files.select(F.col(path).alias("path"), F.from_json(content, kind).alias("p"))
    part = lambda s: parsed.select("path", F.lit(s).alias("section"), F.explode(F.col(f"p.{s}")).alias("name", "version"))
    return part("dependencies").unionByName(part("devDependencies"))


def project_dependencies(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, name of the dependencies that a pyproject file lists in an array."""
    block = F.regexp_extract(content, r"(?s)(?:^|\n)\s*dependencies\s*=\s*\[(.*?)\]", 1)
    names = F.regexp_extract_all(block, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))
    return files.select(F.col(path).alias("path"), F.explode(names).alias("name"))


def changed_files(status: DataFrame, text: str = "text") -> DataFrame:
    """status, path of a name-status listing; a rename counts for its new path."""
    lines = status.select(F.explode(split_lines(F.col(text))).alias("line")).where("trim(line) <> ''")
    parts = F.split("line", "\t")
    return lines.select(F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("path"))


def parsed_reports(reports: DataFrame, content: str = "content") -> DataFrame:
    """score, total_issues, file_count and timestamp that reports in Markdown state."""
    number = lambda p: F.regexp_extract(content, p, 1).cast("int")
    stamp = F.regexp_extract("path", r"(\d{8}_\d{6})", 1)
    return reports.select("path", F.when(stamp != "", F.to_timestamp(stamp, "yyyyMMdd_HHmmss")).alias("timestamp"), number(r"(?i)score\D{0,5}(\d+)").alias("score"), number(r"(?i)issues\D{0,5}(\d+)").alias("total_issues"), number(r"(?i)files\D{0,5}(\d+)").alias("file_count"))


def report_json(findings: DataFrame, path: str) -> None:
    findings.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def markdown_table(counts: DataFrame, most: int = 200) -> str:
    """A small table (counts, scores) as Markdown: for reports of aggregates."""
    rows = counts.limit(most).collect()
    head = counts.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows])


def html_report(title: str, counts: DataFrame, most: int = 200) -> str:
    from html import escape

    rows = counts.limit(most).collect()
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in counts.columns)}</tr>{body}</table></body></html>"


def ascii_table(counts: DataFrame, most: int = 200) -> str:
    """A small table in a frame; wide characters take two columns."""
    import unicodedata

    width = lambda s: sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)
    rows = [[("" if v is None else str(v)) for v in r] for r in counts.limit(most).collect()]
    cols = [max(map(width, c)) for c in zip(counts.columns, *rows, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in cols) + "+"
    show = lambda r: "|" + "|".join(f" {v}{' ' * (w - width(v))} " for v, w in zip(r, cols, strict=True)) + "|"
    return "\n".join([line, show(counts.columns), line, *map(show, rows), line])


def extension_filter(ext: Column, wanted: list[str]) -> Column:
    return F.lower(ext).isin(*wanted)


def config_with_defaults(text: str, defaults: dict) -> dict:
    """A configuration in JSON over nested defaults."""

    def merged(a, b):
        return {k: merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in {*a, *b}}

    return merged(defaults, json.loads(text) if text.strip() else {})
