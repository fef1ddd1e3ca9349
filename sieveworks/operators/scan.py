"""Rule evaluation: a table of pattern rules against a table of files, in one pass over the files.

All rules of a scan become one array expression per file, which is exploded once; a file is read once, however many rules
there are. Offsets of matches come from the pieces between them, so that lines and columns need no user code. Patterns
that the JVM cannot take, or that match the empty text, go to a worker that stops a pattern after a time limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.functions.text import absence_words, dialect, glob_regex

SNIPPET = 100
#: Seconds that one pattern may take on one file; beyond it the file has no match and is counted.
TIME_LIMIT = 0.5


@dataclass
class Rule:
    check_id: str
    pattern: str
    name: str = ""
    level: str = "problem"
    severity: str = "medium"
    category: str = ""
    file_pattern: str = "*"
    suggestion: str = ""
    ignore_case: bool = True
    #: "lines" tests each line by itself, "text" the whole file.
    scope: str = "text"
    words: list[str] | None = field(default=None)

    def __post_init__(self):
        if self.words is None:
            self.words = absence_words(self.pattern)


def java_valid(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  the JVM's own syntax error, wrapped
        return False
    return True


def matches_empty(pattern: str) -> bool:
    try:
        return re.compile(pattern, re.M).search("") is not None
    except re.error:
        return False


def _best(a, b):
    """Of two sets of words of which one has to occur (None: nothing is known), that with the longer shortest word."""
    return max((x for x in (a, b) if x), key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _needed(items, at_most: int = 16):
    """(words of which one occurs in whatever a sequence of parsed items matches or None, the one text it matches or None)."""
    best, run, plain = None, "", True
    for op, arg in items:
        name, found, whole = str(op), None, None
        if name == "LITERAL":
            whole = chr(arg).lower() if arg < 128 else None
        elif name == "SUBPATTERN":
            # flags of a group may change its letters' case, which makes no difference to lower-case words
            found, whole = _needed(arg[3], at_most)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found, whole = _needed(arg[2], at_most)
            whole = whole * arg[0] if whole and arg[0] == arg[1] and len(whole) * arg[0] <= 64 else None
        elif name == "BRANCH":
            each = [(w and {w}) or n for n, w in (_needed(x, at_most) for x in arg[1])]
            found = set().union(*each) if all(each) and sum(map(len, each)) <= at_most else None
        if name in ("ASSERT", "ASSERT_NOT", "AT"):  # of no width
            continue
        if whole:
            run += whole
            continue
        plain = False
        best, run = _best(_best(best, found), run and {run}), ""
    return _best(best, run and {run}), run if plain else None


def needed_words(pattern: str) -> set[str] | None:
    """Words in lower case of which a text has at least one wherever the pattern matches it; None if none are known.

    Patterns that the JVM may read otherwise (classes in classes, quotes, comments) are not taken apart."""
    if re.search(r"\[[^\]]*\[|&&|\\Q|\(\?[a-z]*x", pattern):
        return None
    try:
        import re._parser as parser

        words = _needed(parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern), re.M))[0]
    except (ImportError, re.error, RecursionError, OverflowError):
        return None
    return words if words and min(map(len, words)) > 1 else None


def _matches(content: Column, pattern: str) -> Column:
    """array of struct(position from 1 on, text) of all matches, none of which may be empty."""
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    gaps = F.split(content, pattern, -1)
    ends = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<position:int,text:string>>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("position"), x["m"].alias("text")))).alias("out")),
    )
    return F.when(F.size(found) > 0, ends["out"])


def _folded(content: Column) -> Column:
    """A text in lower case, with the letters that a pattern takes for ASCII letters when it ignores case."""
    return F.lower(F.translate(content, "\u017f\u212a\u0130\u0131", "skii"))


def _numbered(rule: int):
    return lambda m: F.struct(F.lit(rule).alias("rule"), m["position"].alias("position"), m["text"].alias("text"))


def _line_column(frame: DataFrame) -> DataFrame:
    head = F.substring(F.col("content"), F.lit(1), F.col("position") - 1)
    parts = F.split(head, "\n", -1)
    return frame.withColumn("line", F.size(parts)).withColumn("column", F.length(F.element_at(parts, -1)) + 1)


def evaluate(files: DataFrame, rules: list[Rule], path: str = "path", basename: str | None = "basename", content: str = "content", strict_globs: bool = False) -> DataFrame:
    """path, rule_id, line, column, snippet of every match, and one row for each file that lacks all words of an absence
    rule. strict_globs takes a comma list of globs as one glob."""
    spark = files.sparkSession
    base = files.select(F.col(path).alias("path"), (F.col(basename) if basename else F.lit("")).alias("basename"), F.col(content).alias("content"))

    def applies(rule):
        if basename is None or rule.file_pattern in ("", "*"):
            return F.lit(True)
        text = glob_regex(rule.file_pattern.replace(",", "[,]") if strict_globs else rule.file_pattern)
        return F.col("basename").rlike(text)

    native, guarded = [], []
    for i, r in enumerate(rules):
        if r.words:
            gone = F.lit(True)
            for w in r.words:
                gone = gone & ~F.col("_lower").contains(w.lower())
            native.append(F.when(applies(r) & gone, F.array(F.struct(F.lit(i).alias("rule"), F.lit(0).alias("position"), F.lit("").alias("text")))))
        elif matches_empty(r.pattern) or not java_valid(spark, dialect(r.pattern, r.ignore_case)):
            guarded.append((i, r))
        else:
            hit = _matches(F.col("content"), dialect(r.pattern, r.ignore_case))
            may = applies(r)
            if words := needed_words(r.pattern):  # a search for words is far cheaper than a pattern
                may = may & reduce(or_, (F.contains("_folded", F.lit(w)) for w in sorted(words)))
            native.append(F.when(may, F.transform(hit, _numbered(i))))
    kind = "array<struct<rule:int,position:int,text:string>>"
    out = None
    if native:
        every = F.flatten(F.array(*(F.coalesce(c, F.array().cast(kind)) for c in native)))
        # not as a column with a filter: the filter would move below it and match every pattern a second time
        out = base.withColumns({"_folded": _folded(F.col("content")), "_lower": F.lower("content")}).select("path", "content", F.inline(every))
        out = _line_column(out).select("path", "rule", "line", "column", F.substring("text", 1, SNIPPET).alias("snippet"))
    if guarded:
        for i, r in guarded:
            part = guarded_matches(base.where(applies(r)), i, r)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path string, rule_id string, line int, column int, snippet string")
    names = spark.createDataFrame([(i, r.check_id) for i, r in enumerate(rules)], "rule int, rule_id string")
    return out.join(F.broadcast(names), "rule").select("path", "rule_id", F.when(F.col("line") > 0, F.col("line")).alias("line"), "column", "snippet")


def guarded_matches(files: DataFrame, number: int, rule: Rule, limit: float = TIME_LIMIT) -> DataFrame:
    """Matches of one pattern by a worker that gives up on a file after the time limit; empty matches are left out."""
    schema = T.StructType([files.schema["path"], T.StructField("rule", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("snippet", T.StringType())])
    pattern, flags = rule.pattern, rule.ignore_case

    def run(batches):
        import regex

        try:
            found = regex.compile(pattern, regex.M | (regex.I if flags else 0))
        except regex.error:
            found = None
        for b in batches:
            rows = []
            if found is not None:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    mine = []
                    try:
                        for m in found.finditer(text or "", timeout=limit):
                            if m.end() > m.start():
                                mine.append((path, number, text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()), m.group()[:SNIPPET]))
                    except TimeoutError:
                        mine = []
                    rows += mine
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=schema.names)

    return files.select("path", "content").mapInArrow(run, schema)


def evaluate_lines(lines: DataFrame, rules: list[Rule], skip_comments: bool = False) -> DataFrame:
    """lines (path, line_no, line, ...) with rule_id of every rule that a line matches; one row per line and rule."""
    tests = [F.when(F.col("line").rlike(dialect(r.pattern, r.ignore_case)), F.lit(r.check_id)) for r in rules]
    hits = F.filter(F.array(*tests), lambda x: x.isNotNull())
    out = lines.withColumn("_hits", hits).where(F.size("_hits") > 0)
    if skip_comments:
        from sieveworks.functions.text import is_comment

        out = out.where(~is_comment(F.col("line")))
    return out.select(*lines.columns, F.explode("_hits").alias("rule_id"))


def prune(rules: DataFrame, languages: DataFrame) -> DataFrame:
    """Rules (with languages, an array) that concern a detected language; rules without languages stay."""
    kept = rules.where(F.col("languages").isNull() | (F.size("languages") == 0))
    some = rules.where(F.size("languages") > 0)
    return kept.unionByName(some.join(F.broadcast(languages.select(F.col("language").alias("_l")).distinct()), F.array_contains("languages", F.col("_l")), "left_semi"))


def detected_languages(files: DataFrame, extensions: dict[str, str], ext: str = "ext") -> DataFrame:
    from sieveworks.schema import lookup

    return files.select(lookup(extensions, F.lower(ext)).alias("language")).where("language is not null").distinct()
