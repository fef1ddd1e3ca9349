"""What happens to findings after a scan: filters, suppression, deduplication, consensus.

Findings are rows with file, line, rule_id and, as an operator needs them, engine, severity, confidence, category,
message, source, and ord, the order in which they came. Every choice among rows ends in ord, so that results do not
depend on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.text import is_comment, to_lines
from sieveworks.operators.alike import similar_links, similar_pairs  # noqa: F401  of this kind, too
from sieveworks.schema import CONFIDENCE_PLACE, ENGINE_PRIORITY, SOURCE_PRIORITY, lookup, severity_rank, tolerance
from sieveworks.session import ensure_checkpoints

# What the comment of a suppression looks like.
_LEAD = r"(?i)(?:#|//|/\*)\s*qa[-_]?"
MARKS = {
    "line": _LEAD + r"ignore\s*:\s*(.+?)\s*(?:\*/)?\s*$",
    "nosonar": _LEAD + r"nosonar\b",
    "begin": _LEAD + r"ignore[-_]?begin\b",
    "end": _LEAD + r"ignore[-_]?end\b",
    "file": _LEAD + r"ignore[-_]?file\s*:\s*(.+?)\s*(?:\*/)?\s*$",
    "all": _LEAD + r"ignore[-_]?all\b",
}
#: Lines at the top of a file in which it can suppress rules for the whole file.
HEADER_LINES = 5


def path_contains(path: Column, words: list[str]) -> Column:
    """Whether a path, with slashes and in lower case, contains any of the words."""
    text = F.lower(F.translate(path, "\\", "/"))
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w))


def name_matches(name: Column, globs: list[str]) -> Column:
    from sieveworks.functions.text import glob_regex

    return name.rlike(glob_regex(",".join(globs)))


def marked_generated(content: Column, marks: list[str], first: int = 10) -> Column:
    """Whether one of the first lines contains a mark of generated files."""
    head = F.slice(F.split(content, "\n", -1), 1, first)
    return F.exists(head, lambda line: F.exists(F.array(*(F.lit(m.lower()) for m in marks)), lambda m: F.contains(F.lower(line), m)))


def split_by(findings: DataFrame, removed: Column, reason: str) -> DataFrame:
    """findings with removed and reason; nothing is lost."""
    return findings.withColumn("removed", F.coalesce(removed, F.lit(False))).withColumn("reason", F.when(F.col("removed"), F.lit(reason)))


def rule_list(text: Column) -> Column:
    """The upper-case rule ids of a suppression comment; a note after " - " or " # " is left out; all, * and the like give ALL."""
    bare = F.regexp_replace(text, r"\s+[-#]\s.*$", "")
    ids = F.filter(F.transform(F.split(bare, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return F.transform(ids, lambda x: F.when(x.isin("ALL", "*", "全部"), F.lit("ALL")).otherwise(x))


def depths(lines: DataFrame, begin: Column, end: Column, key: str = "path", order: str = "line_no") -> DataFrame:
    """lines with depth: begun less ended blocks so far, never under 0; a line that does both begins first.

    The clamped running sum is the plain one less the least it has been below 0, which takes two windows."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # a line's lowest point is after all of it, as it begins before it ends
    marked = lines.withColumn("_step", begin.cast("int") - end.cast("int")).withColumn("_sum", F.sum("_step").over(w))
    return marked.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_step", "_sum")


def suppressions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no, header (rule ids for the whole file), own and previous (ids for this line, the latter from a comment
    right above), in_block (a block is open after the lines above)."""
    lines = to_lines(files, path, content).withColumnRenamed(path, "path")
    has = lambda k: F.col("line").rlike(MARKS[k])
    ids = lambda k: F.when(has(k), rule_list(F.regexp_extract("line", MARKS[k], 1)))
    every = F.array(F.lit("ALL"))
    lines = lines.withColumn("own", F.when(has("nosonar") | has("all"), every).otherwise(F.when(~has("begin") & ~has("end") & ~has("file"), ids("line"))))
    lines = lines.withColumn("file_ids", F.when(F.col("line_no") <= HEADER_LINES, F.when(has("all"), every).otherwise(ids("file"))))
    lines = depths(lines, has("begin"), has("end"))
    w = Window.partitionBy("path").orderBy("line_no")
    whole = Window.partitionBy("path")
    above = F.when(is_comment(F.col("line")), F.col("own"))
    return lines.select("path", "line_no", F.array_distinct(F.flatten(F.collect_list("file_ids").over(whole))).alias("header"), "own", F.lag(above).over(w).alias("previous"), (F.coalesce(F.lag("depth").over(w), F.lit(0)) > 0).alias("in_block"))


def suppress(findings: DataFrame, marks: DataFrame, skip: list[str] = (), directories: DataFrame | None = None) -> DataFrame:
    """findings with suppress_type: global, directory, file, block, line or null; the first that holds.

    directories: directory, rule_id (as listed for the directory)."""
    covers = lambda c: F.coalesce(F.array_contains(c, "ALL") | F.array_contains(c, F.upper("rule_id")), F.lit(False))
    out = findings.join(marks.select(F.col("path").alias("file"), F.col("line_no").alias("line"), "header", "own", "previous", "in_block"), ["file", "line"], "left")
    if directories is not None:
        own = directories.groupBy("directory").agg(F.collect_set(F.upper("rule_id")).alias("_dir"))
        out = out.withColumn("directory", F.regexp_replace("file", r"/?[^/]*$", "")).join(own, "directory", "left").drop("directory")
    else:
        out = out.withColumn("_dir", F.lit(None).cast("array<string>"))
    kind = F.when(F.col("rule_id").isin(*skip) if skip else F.lit(False), "global").when(covers("_dir"), "directory").when(covers("header"), "file").when(F.coalesce("in_block", F.lit(False)), "block").when(covers("own") | covers("previous"), "line")
    return out.select(*findings.columns, kind.alias("suppress_type"))


def _quality(ord_col: str = "ord", source: bool = False) -> list[Column]:
    """Sort keys: precise engines, precise sources, severe, confident, early."""
    keys = [lookup(ENGINE_PRIORITY, F.col("engine"), 99)]
    if source:
        keys.append(lookup(SOURCE_PRIORITY, F.col("source"), 99))
    return [*keys, -severity_rank(F.col("severity")), lookup(CONFIDENCE_PLACE, F.col("confidence"), 3), F.col(ord_col)]


def exact_dedup(findings: DataFrame, keys: tuple[str, ...] = ("file", "line", "rule_id")) -> DataFrame:
    """findings with kept: the best row of each (file, line, rule)."""
    w = Window.partitionBy(*keys).orderBy(*_quality())
    return findings.withColumn("kept", F.row_number().over(w) == 1)


def clustered(findings: DataFrame, keys: tuple[str, ...], position: str, gap) -> DataFrame:
    """findings with cluster: rows of the same keys whose positions follow each other within gap have the same number."""
    w = Window.partitionBy(*keys).orderBy(position, "ord")
    jump = F.coalesce((F.col(position) - F.lag(position).over(w)) > gap, F.lit(False))
    return findings.withColumn("_jump", jump.cast("int")).withColumn("cluster", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def cluster_dedup(findings: DataFrame, concepts: DataFrame, gap: int = 3) -> DataFrame:
    """findings with concept, cluster, kept, merged_from: rules of one concept (concepts: rule_id, concept) in lines that
    follow each other within gap are one finding; rules without a concept are all kept."""
    tagged = findings.join(F.broadcast(concepts), "rule_id", "left")
    grouped = clustered(tagged.where("concept is not null"), ("file", "concept"), "line", gap)
    group = ("file", "concept", "cluster")
    w = Window.partitionBy(*group).orderBy(*_quality(source="source" in findings.columns))
    whole = Window.partitionBy(*group)
    best = grouped.withColumn("kept", F.row_number().over(w) == 1).withColumn("merged_from", F.array_sort(F.collect_set("rule_id").over(whole)))
    alone = tagged.where("concept is null").withColumns({"cluster": F.lit(None).cast("long"), "kept": F.lit(True), "merged_from": F.array("rule_id")})
    return best.unionByName(alone)


def bucket(line: Column, category: Column) -> Column:
    """The first line of the stretch of 2 t + 1 lines that a line falls in, t by category."""
    width = tolerance(category) * 2 + 1
    return F.floor(line / width) * width


def normal_type(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9一-鿿]", "")


def bucket_groups(findings: DataFrame) -> DataFrame:
    """findings with bucket_key of file, line bucket and normalised type (category, else rule id, else the message's start)."""
    kind = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.when(F.col("rule_id") != "", F.col("rule_id")), F.substring("message", 1, 30))
    path = F.regexp_replace(F.translate("file", "\\", "/"), r"(^|/)\./", "$1")
    return findings.withColumn("bucket_key", F.concat_ws(":", path, bucket(F.col("line"), F.col("category")).cast("string"), normal_type(kind)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable), by least labels that spread and jump until they rest; lineage is cut each round."""
    ensure_checkpoints(edges.sparkSession)
    # the edges may be dear: they are computed once for both directions, and kept while the checkpoint is written
    ways = F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))))
    kept = edges.select(ways.alias("e")).select("e.*").distinct().persist()
    both = kept.checkpoint()
    kept.unpersist()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "node").checkpoint()
    while True:
        spread = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("m"))
        next_ = labels.join(spread, "node").select("node", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("c").alias("j"))
        next_ = next_.join(jump, "c", "left").select("node", F.least("c", F.coalesce("j", "c")).alias("c"), "old").checkpoint()
        if next_.where("c <> old").isEmpty():
            break
        labels = next_.select("node", "c")
    return labels.select("node", F.col("c").alias("component"))


def consensus(issues: DataFrame, keys: list[str], total: Column, ord_col: str = "ord") -> DataFrame:
    """One row per group: the issue of the best engine, the worst severity, the longest message, all engines and ids,
    consensus (share of engines) and its band."""
    rank = severity_rank(F.col("severity"))
    best = F.struct(lookup(ENGINE_PRIORITY, F.col("engine"), 99).alias("p"), F.col(ord_col).alias("o"))
    grouped = issues.groupBy(*keys).agg(
        F.min_by("rule_id", best).alias("rule_id"),
        F.max_by("severity", F.struct(rank, -F.col(ord_col))).alias("severity"),
        F.max_by("message", F.struct(F.length("message"), -F.col(ord_col))).alias("message"),
        F.array_sort(F.collect_set("engine")).alias("detected_by"),
        F.array_sort(F.collect_set("rule_id")).alias("source_ids"),
        (F.max(rank) - F.min(rank)).alias("spread"),
    )
    share = F.size("detected_by") / F.greatest(total, F.lit(1))
    return grouped.withColumn("consensus", share).withColumn("confidence", F.when(share >= 0.6, "high").when(share >= 0.3, "medium").otherwise("low")).withColumn("conflict", F.col("spread") >= 2)


# Names that are no breach of a naming convention.
ABBREVIATIONS = "URL API HTTP HTTPS ID DB SQL HTML CSS JSON XML YAML CSV IO OS CPU GPU RAM TCP UDP DNS SSH SSL TLS JWT OAuth SDK CLI GUI REST GraphQL CRUD MVC MVP VM CI CD AC DC HTML5 ES6 TS JS UTF ASCII UUID URI FTP SMTP IMAP AWS GCP NFC BLE USB HDMI VGA PNG JPG GIF SVG PDF EOF NULL NAN OK NG TODO FIXME HACK NOTE INFO MAX MIN AVG SUM CNT LEN TMP SRC DST BUF ERR MSG REQ RES CTX CFG ENV DEV PROD STG AUTH PERM".split()


def false_positive(rule_id: Column, message: Column, snippet: Column) -> Column:
    """Why a finding is none: a usual abbreviation in a naming rule; else null."""
    naming = rule_id.startswith("NAME-") | rule_id.startswith("5.1") | rule_id.startswith("5.2")
    word = snippet.rlike(r"(?i)\b(" + "|".join(ABBREVIATIONS) + r")\b")
    return F.when(naming & word, F.lit("abbreviation"))


def downgraded(level: Column, rule_id: Column, message: Column, snippet: Column) -> Column:
    """The level, or info for an open task that names its issue."""
    text = F.concat_ws(" ", message, snippet)
    task = rule_id.startswith("14.") | rule_id.contains("TODO") | rule_id.contains("FIXME")
    return F.when(task & (text.rlike(r"(?i)(?:TODO|FIXME|HACK)\s*[#(\-]\s*#?\d+") | text.rlike(r"(?i)issue\s*#?\s*\d+")), F.lit("info")).otherwise(level)
