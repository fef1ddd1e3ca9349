"""Facts across files: duplicated blocks, repeated literals, linkage of names on two sides, claims against counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.functions.text import is_comment, masked_identifiers, shingles, to_lines


def code_lines(files: DataFrame, path: str, content: str, drop_comments: bool = True) -> DataFrame:
    """path, line_no (renumbered), line: trimmed lines that are neither empty nor, if asked, comments."""
    lines = to_lines(files, path, content).withColumn("line", F.trim("line")).where("line <> ''")
    if drop_comments:
        lines = lines.where(~is_comment(F.col("line")))
    w = Window.partitionBy(path).orderBy("line_no")
    return lines.select(F.col(path).alias("path"), F.row_number().over(w).alias("line_no"), "line")


def duplicate_rate(lines: DataFrame, block: int = 5) -> DataFrame:
    """One row: lines, lines in blocks that two files share, and their share. Hashes of blocks are shuffled, not texts."""
    hashed = shingles(lines, "path", block).select("path", "line_no", F.md5("shingle").alias("h"))
    common = hashed.groupBy("h").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).where("lo <> hi").select("h")
    starts = hashed.join(common, "h", "left_semi").select("path", "line_no", F.lit(1).alias("s"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(1 - block, 0)
    covered = lines.select("path", "line_no").join(starts, ["path", "line_no"], "left").withColumn("d", F.max("s").over(w))
    out = covered.agg(F.count(F.lit(1)).alias("total_lines"), F.coalesce(F.sum("d"), F.lit(0)).alias("dup_lines"))
    return out.withColumn("dup_rate", F.when(F.col("total_lines") > 0, F.col("dup_lines") / F.col("total_lines")).otherwise(0.0))


def similar_blocks(lines: DataFrame, size: int = 10, step: int = 5, key_chars: int = 200) -> DataFrame:
    """block_key, n, first (path and line): blocks of size lines, each step lines, that are equal with identifiers masked."""
    masked = lines.withColumn("line", masked_identifiers(F.col("line")))
    w = Window.partitionBy("path").orderBy("line_no")
    text = F.concat_ws("|", "line", *(F.lead("line", k).over(w) for k in range(1, size)))
    blocks = masked.withColumn("block", text).withColumn("_last", F.lead("line", size - 1).over(w)).where(F.col("_last").isNotNull() & ((F.col("line_no") - 1) % step == 0))
    keyed = blocks.select("path", "line_no", F.md5(F.substring("block", 1, key_chars)).alias("block_key"))
    return keyed.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_no")).alias("first")).where("n > 1")


def repeated(values: DataFrame, value: str, least: int) -> DataFrame:
    """value, n of values that occur more than least times."""
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def literals(files: DataFrame, content: str, shortest: int = 5) -> DataFrame:
    """literal: every quoted text of shortest characters at least."""
    found = F.regexp_extract_all(F.col(content), F.lit(r"[\"']([^\"'\n]{" + str(shortest) + r",})[\"']"), F.lit(1))
    return files.select(F.explode(found).alias("literal"))


def object_shapes(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, shape, n: key lists of three keys or more that more than two object literals of a file share."""
    bodies = files.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(content), F.lit(r"\{([^{}]{5,500})\}"), F.lit(1))).alias("body"))
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:^|,)\s*[\"']?([A-Za-z_]\w*)[\"']?\s*:"), F.lit(1))))
    shaped = bodies.withColumn("keys", keys).where(F.size("keys") >= 3)
    return shaped.groupBy("path", F.array_join("keys", ",").alias("shape")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")


def shared_names(names: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """name, files, paths: names that several files define."""
    return names.select(name, path).distinct().groupBy(name).agg(F.count(path).alias("files"), F.array_sort(F.collect_list(path)).alias("paths")).where("files > 1")


def orphans(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """routes (domain, action) that no call names; domains that are only called with computed actions (null) are left out."""
    dynamic = calls.groupBy("domain").agg(F.count("action").alias("named")).where("named = 0").select("domain")
    return routes.join(calls.where("action is not null"), ["domain", "action"], "left_anti").join(dynamic, "domain", "left_anti")


def ghosts(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """Named calls that no route answers."""
    return calls.where("action is not null").distinct().join(routes, ["domain", "action"], "left_anti")


def coverage(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: distinct calls, those answered, and the percentage, 100 if there is no call."""
    named = calls.where("action is not null").select("domain", "action").distinct()
    hit = named.join(routes.select("domain", "action", F.lit(1).alias("hit")).distinct(), ["domain", "action"], "left")
    out = hit.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("hit"), F.lit(0)).alias("answered"))
    return out.withColumn("coverage", F.when(F.col("calls") == 0, 100.0).otherwise(F.col("answered") * 100.0 / F.col("calls")))


def near_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left_name, right_name: different names that are equal with dashes, underscores and blanks alike, in lower case."""
    norm = lambda c: F.lower(F.translate(c, "- ", "__"))
    a = left.select(F.col(name).alias("left_name"), norm(F.col(name)).alias("_k")).distinct()
    b = right.select(F.col(name).alias("right_name"), norm(F.col(name)).alias("_k")).distinct()
    return a.join(b, "_k").where("left_name <> right_name").select("left_name", "right_name")


def package_name(col: Column) -> Column:
    """A dependency's name as indexes compare it."""
    return F.lower(F.regexp_replace(F.trim(col), r"[-_.]+", "-"))


def undeclared(imports: DataFrame, *known: DataFrame, name: str = "module") -> DataFrame:
    """imports whose top-level name is in none of the known sets (each with a column of that name), names compared alike."""
    out = imports.withColumn("_k", package_name(F.substring_index(name, ".", 1)))
    for k in known:
        out = out.join(k.select(package_name(F.col(name)).alias("_k")).distinct(), "_k", "left_anti")
    return out.drop("_k")


def claims_against(claims: DataFrame, counts: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """claims (category, quantity) joined to counts (category, actual) where the actual is under low or over high times the claim."""
    return claims.join(F.broadcast(counts), "category").where((F.col("actual") < F.col("quantity") * low) | (F.col("actual") > F.col("quantity") * high))


#: Distinct n-grams of the reference texts that may be broadcast; beyond them both sides are joined by shuffling.
BROADCAST_GRAMS = 1_000_000


def _bound(array: Column, then) -> Column:
    """then(array), with the array evaluated once per row however often then names it: it is the argument of a lambda."""
    return F.transform(F.array(array), then)[0]


def word_grams(text: Column, n: int) -> Column:
    """array of struct(h, g): two hashes, 96 bits together, of each run of n words of a lower-cased text.

    A run is the pair of the two runs of half its length, overlapping if n is odd, that begin and end it."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9à-ÿ]+"), lambda w: w != "")

    def runs(size, pair):
        if size == 1:
            return F.transform(words, lambda w: pair(w))
        half, shift = (size + 1) // 2, size // 2
        count = lambda r: F.greatest(F.lit(0), F.size(r) - shift)
        return _bound(runs(half, F.xxhash64), lambda r: F.zip_with(F.slice(r, 1, count(r)), F.slice(r, shift + 1, count(r)), lambda x, y: pair(x, y)))

    return runs(n, lambda *x: F.struct(F.xxhash64(*x).alias("h"), F.hash(*x).alias("g")))


def ngram_overlap(texts: DataFrame, key: str, text: str, reference: DataFrame, ref_key: str, ref_text: str, n: int) -> DataFrame:
    """key, ref_key, shared: numbers of distinct word n-grams that a text shares with each reference text.

    The reference's hashes go to the texts, if they are few enough, so that only common n-grams are shuffled."""
    a = texts.select(F.col(key).alias("key"), F.inline_outer(word_grams(F.col(text), n)))  # outer: no filter on the array is inferred, which would build it twice
    b = reference.select(F.col(ref_key).alias("ref_key"), F.inline_outer(word_grams(F.col(ref_text), n))).distinct()
    if b.count() <= BROADCAST_GRAMS:
        b = F.broadcast(b)
    return a.join(b, ["h", "g"]).groupBy("key", "ref_key").agg(F.countDistinct("h", "g").alias("shared"))
