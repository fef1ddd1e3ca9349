"""Queries that deduplicate, merge and score findings. Events stand for findings: users for files, types for engines and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveworks.operators import findings as N
from sieveworks.operators import score as P
from sieveworks.plans.base import query, table

_ENGINE = {"click": "semgrep", "view": "rule", "error": "rule", "signup": "ai", "purchase": "other"}
_SEVERITY = {"error": "blocker", "purchase": "high", "signup": "medium", "view": "low", "click": "info"}
_CATEGORY = {"error": "security", "purchase": "performance hints", "signup": "logic", "view": "code_quality", "click": "Security check"}


def _case(values, col="event_type"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


#: Events as findings: file (user), line (minutes of the day), rule (event type), engine, severity, category, confidence.
_F = f"""(SELECT event_id AS ord, user_id AS file, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::BIGINT AS line, event_type AS rule_id, {_case(_ENGINE)} AS engine, {_case(_SEVERITY)} AS severity, {_case(_CATEGORY)} AS category,
CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, event_type || ' ' || props AS message, CAST(ts AS DATE) AS day FROM events)"""
_EP = "CASE engine WHEN 'semgrep' THEN 1 WHEN 'rule' THEN 2 WHEN 'ai' THEN 3 ELSE 99 END"
_SR = "CASE severity WHEN 'blocker' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_CP = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"


def findings_of(spark, sf):
    from sieveworks.schema import lookup

    e = table(spark, sf, "events")
    kind = lambda d: lookup(d, F.col("event_type"))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("file"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("line"), F.col("event_type").alias("rule_id"), kind(_ENGINE).alias("engine"), kind(_SEVERITY).alias("severity"), kind(_CATEGORY).alias("category"), F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low").alias("confidence"), F.concat_ws(" ", "event_type", "props").alias("message"), F.to_date("ts").alias("day"))


@query(f"SELECT ord AS event_id, row_number() OVER (PARTITION BY file, day, severity ORDER BY {_EP}, -({_SR}), {_CP}, ord) = 1 AS kept FROM {_F}")
def exact_dedup(spark, sf):
    return N.exact_dedup(findings_of(spark, sf), ("file", "day", "severity")).select(F.col("ord").alias("event_id"), "kept")


@query(f"SELECT ord AS event_id, CASE WHEN row_number() OVER (PARTITION BY file, rule_id, day ORDER BY ord) = 1 THEN 'active' ELSE 'fp' END AS status FROM {_F}")
def runner_dedup(spark, sf):
    w = Window.partitionBy("file", "rule_id", "day").orderBy("ord")
    return findings_of(spark, sf).select(F.col("ord").alias("event_id"), F.when(F.row_number().over(w) == 1, "active").otherwise("fp").alias("status"))


@query("SELECT h, n, ids FROM (SELECT md5(text) AS h, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_docs_exact(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("h"), "doc_id")
    return docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids")).where("n > 1")


_CONCEPT = "(VALUES ('click', 'input'), ('view', 'input'), ('error', 'fault')) c(rule_id, concept)"


@query(
    f"""WITH t AS (SELECT f.*, c.concept FROM {_F} f LEFT JOIN {_CONCEPT} USING (rule_id)),
j AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file, concept ORDER BY line, ord) > 3 THEN 1 ELSE 0 END AS jump FROM t WHERE concept IS NOT NULL),
k AS (SELECT *, sum(jump) OVER (PARTITION BY file, concept ORDER BY line, ord ROWS UNBOUNDED PRECEDING) AS cluster FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY file, concept, cluster ORDER BY {_EP}, -({_SR}), {_CP}, ord) = 1 AS kept FROM k),
m AS (SELECT file, concept, cluster, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS merged FROM k GROUP BY ALL)
SELECT ord AS event_id, kept, merged FROM b JOIN m USING (file, concept, cluster) UNION ALL SELECT ord, true, rule_id FROM t WHERE concept IS NULL"""
)
def line_cluster_dedup(spark, sf):
    concepts = spark.createDataFrame([("click", "input"), ("view", "input"), ("error", "fault")], "rule_id string, concept string")
    return N.cluster_dedup(findings_of(spark, sf), concepts).select(F.col("ord").alias("event_id"), "kept", F.array_join("merged_from", ",").alias("merged"))


_TOL = "CASE WHEN contains(lower(category), 'security') THEN 1 WHEN contains(lower(category), 'performance') THEN 5 ELSE 3 END"


@query(f"""SELECT file::VARCHAR || ':' || ((line // (2 * t + 1)) * (2 * t + 1))::VARCHAR || ':' || regexp_replace(lower(trim(category)), '[^a-z0-9]', '', 'g') AS bucket_key, count(*) AS n, min(ord) AS first_ord FROM (SELECT *, {_TOL} AS t FROM {_F}) GROUP BY 1""")
def bucket_dedup(spark, sf):
    return N.bucket_groups(findings_of(spark, sf).withColumn("file", F.col("file").cast("string"))).groupBy("bucket_key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def _whole(spark, sf, alike=N.similar_pairs):
    return alike(table(spark, sf, "documents").where("text is not null"), ["source"], "doc_id", "text")


_TEXT_GRAMS = "(SELECT doc_id, source, CASE WHEN length(text) < 2 THEN [text] ELSE list_distinct(list_transform(list_zip(string_split(text, '')[:-2], string_split(text, '')[2:]), lambda p: p[1] || p[2])) END AS g FROM documents WHERE text IS NOT NULL)"
_ALIKE = f"(SELECT a, b, common / (na + nb - common)::DOUBLE AS similarity FROM (SELECT p.doc_id AS a, q.doc_id AS b, len(p.g) AS na, len(q.g) AS nb, len(list_intersect(p.g, q.g)) AS common FROM {_TEXT_GRAMS} p JOIN {_TEXT_GRAMS} q ON p.source = q.source AND p.doc_id < q.doc_id))"


@query(f"SELECT a, b, round(similarity, 6) AS similarity FROM {_ALIKE} WHERE similarity >= 0.8 - 1e-9")
def jaccard_ngram_pairs(spark, sf):
    """Pairs of documents of one source whose whole texts, of all languages, are alike by pairs of characters."""
    return _whole(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_ALIKE} WHERE similarity >= 0.8 - 1e-9), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a"""
)
def similarity_components(spark, sf):
    return N.components(_whole(spark, sf, N.similar_links))


_GROUPS = f"(SELECT *, line // 30 AS slot FROM {_F})"


@query(
    f"""SELECT file, day::VARCHAR AS day, slot, arg_min(rule_id, ({_EP})::BIGINT * 1000000000 + ord) AS rule_id, arg_max(severity, ({_SR})::BIGINT * 1000000000 - ord) AS severity,
arg_max(message, length(message)::BIGINT * 1000000000 - ord) AS message, array_to_string(list_sort(list(DISTINCT engine)), ',') AS detected_by, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS source_ids,
round(count(DISTINCT engine) / 4.0, 6) AS consensus, CASE WHEN count(DISTINCT engine) / 4.0 >= 0.6 THEN 'high' WHEN count(DISTINCT engine) / 4.0 >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM {_GROUPS} GROUP BY file, day, slot"""
)
def consensus_merge(spark, sf):
    f = findings_of(spark, sf).withColumn("slot", F.floor(F.col("line") / 30)).withColumn("day", F.col("day").cast("string"))
    out = N.consensus(f, ["file", "day", "slot"], F.lit(4))
    return out.select("file", "day", "slot", "rule_id", "severity", "message", F.array_join("detected_by", ",").alias("detected_by"), F.array_join("source_ids", ",").alias("source_ids"), F.round("consensus", 6).alias("consensus"), "confidence")


@query(f"SELECT file, day::VARCHAR AS day, (max({_SR}) - min({_SR}))::BIGINT AS spread FROM {_F} GROUP BY file, day HAVING max({_SR}) - min({_SR}) >= 2")
def severity_conflicts(spark, sf):
    f = findings_of(spark, sf).withColumn("day", F.col("day").cast("string"))
    return N.consensus(f, ["file", "day"], F.lit(4)).where("conflict").select("file", "day", F.col("spread").cast("long").alias("spread"))


_LEVELS = "CASE rule_id WHEN 'error' THEN 'blocking' WHEN 'purchase' THEN 'problem' WHEN 'view' THEN 'problem' ELSE 'suggestion' END"


def _leveled(spark, sf):
    level = F.when(F.col("rule_id") == "error", "blocking").when(F.col("rule_id").isin("purchase", "view"), "problem").otherwise("suggestion")
    rule = F.when(F.col("rule_id") == "purchase", "9.1").when(F.col("rule_id") == "view", "4.2").otherwise(F.col("rule_id"))
    return findings_of(spark, sf).withColumn("level", level).withColumn("rule_id", rule).withColumn("category", F.when(F.col("category") == "security", "security").otherwise("")).withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH p AS (SELECT file, day::VARCHAR AS day, sum(CASE rule_id WHEN 'error' THEN 40 WHEN 'view' THEN 8 ELSE 0 END) AS bug_off, sum(CASE rule_id WHEN 'purchase' THEN 5 ELSE 0 END) AS smell_off FROM {_F} GROUP BY 1, 2),
d AS (SELECT file, day, greatest(0, 100 - bug_off)::BIGINT AS bug, greatest(0, 100 - smell_off)::BIGINT AS code_smell, 100::BIGINT AS engineering_maturity FROM p)
SELECT *, ((bug * 6 + code_smell * 3 + engineering_maturity) // 10)::BIGINT AS total FROM d"""
)
def score_weighted(spark, sf):
    out = P.weighted(_leveled(spark, sf), "file", "day")
    return out.select("file", "day", *(F.col(c).cast("long").alias(c) for c in ("bug", "code_smell", "engineering_maturity", "total")))


@query(f"""SELECT file, day, e, w, i, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'needs work' WHEN score >= 30 THEN 'serious' ELSE 'critical' END AS level FROM (
SELECT file, day, e, w, i, round_even(greatest(0.0, 100 - (e * 5.0 + w * 2.0 + i * 0.5)), 0)::BIGINT AS score FROM (SELECT file, day::VARCHAR AS day, count(*) FILTER (rule_id = 'error') AS e, count(*) FILTER (rule_id = 'purchase') AS w, count(*) FILTER (rule_id = 'signup') AS i FROM {_F} GROUP BY file, day))""")
def score_deduction(spark, sf):
    n = lambda k: F.count(F.when(F.col("rule_id") == k, 1))
    g = findings_of(spark, sf).withColumn("day", F.col("day").cast("string")).groupBy("file", "day").agg(n("error").alias("e"), n("purchase").alias("w"), n("signup").alias("i"))
    g = g.withColumn("score", P.deduction({"error": F.col("e"), "warning": F.col("w"), "info": F.col("i")}, P.PLAIN).cast("long"))
    return g.withColumn("level", P.band(F.col("score"), *P.LEVELS))


@query("SELECT source, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'needs work' ELSE 'severe' END AS grade FROM (SELECT source, floor(100.0 * sum(quality) / count(*))::BIGINT AS score FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def grade_bands(spark, sf):
    g = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.floor(F.lit(100.0) * F.sum("quality") / F.count(F.lit(1))).alias("score"))
    return g.withColumn("grade", P.band(F.col("score"), *P.GRADES))


@query("SELECT n_files, CASE WHEN n_files < 50 THEN 'small' WHEN n_files <= 200 THEN 'medium' ELSE 'large' END AS scale, CASE WHEN n_files < 50 THEN 0.75 WHEN n_files <= 200 THEN 0.7 ELSE 0.65 END::DOUBLE AS threshold, source FROM (SELECT source, count(*) AS n_files FROM documents GROUP BY source UNION ALL SELECT 'all', count(*) FROM documents)")
def contract_thresholds(spark, sf):
    from sieveworks.schema import scale

    d = table(spark, sf, "documents")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_files")).unionByName(d.agg(F.count(F.lit(1)).alias("n_files")).withColumn("source", F.lit("all")))
    return g.select("n_files", scale(F.col("n_files")).alias("scale"), P.contract_threshold(2, F.col("n_files")).alias("threshold"), "source")


@query(f"SELECT severity, engine, count(*) AS n, count(DISTINCT file) AS files, count(*) FILTER (confidence = 'high') AS sure FROM {_F} GROUP BY CUBE (severity, engine)")
def report_counts(spark, sf):
    return findings_of(spark, sf).cube("severity", "engine").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.count(F.when(F.col("confidence") == "high", 1)).alias("sure"))


@query(f"SELECT day::VARCHAR AS day, list_sort(list(DISTINCT severity))[1] AS first_severity, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'low') AS low FROM {_F} GROUP BY day")
def severity_pivot(spark, sf):
    f = findings_of(spark, sf).withColumn("day", F.col("day").cast("string"))
    p = f.groupBy("day").pivot("severity", ["blocker", "high", "low"]).count().na.fill(0)
    return p.join(f.groupBy("day").agg(F.min("severity").alias("first_severity")), "day").select("day", "first_severity", "blocker", "high", "low")


@query(f"SELECT ord AS event_id FROM {_F} ORDER BY {_SR} DESC, {_CP}, ord LIMIT 25")
def top_findings(spark, sf):
    """The 25 worst findings, as a report shows them."""
    from sieveworks.schema import CONFIDENCE_PLACE, lookup, severity_rank

    f = findings_of(spark, sf)
    return f.orderBy(F.desc(severity_rank(F.col("severity"))), lookup(CONFIDENCE_PLACE, F.col("confidence"), 3), "ord").limit(25).select(F.col("ord").alias("event_id"))


@query(f"SELECT file, ord AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_SR} DESC, ord) AS r FROM {_F}) WHERE r <= 3")
def findings_per_file_cap(spark, sf):
    """The three worst findings of each file, as reports cap them."""
    from sieveworks.schema import severity_rank

    w = Window.partitionBy("file").orderBy(F.desc(severity_rank(F.col("severity"))), "ord")
    return findings_of(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 3").select("file", F.col("ord").alias("event_id"))


@query("SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM (SELECT item_id, list_distinct(list_transform(list_zip(string_split(text, '')[:-2], string_split(text, '')[2:]), lambda p: p[1] || p[2])) AS g FROM benchmark) a JOIN (SELECT item_id, list_distinct(list_transform(list_zip(string_split(text, '')[:-2], string_split(text, '')[2:]), lambda p: p[1] || p[2])) AS g FROM benchmark) b ON a.item_id < b.item_id WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.4 - 1e-9")
def benchmark_similarity(spark, sf):
    """Benchmark items that are alike by pairs of characters."""
    return N.similar_pairs(table(spark, sf, "benchmark"), [], "item_id", "text", 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))
