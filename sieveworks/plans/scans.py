"""Queries that scan texts: lines, rules, suppression, false positives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveworks.functions import text as X
from sieveworks.operators import findings as N
from sieveworks.operators import scan as S
from sieveworks.plans.base import query, table
from sieveworks.sources import corpus

SECRETS = [S.Rule("B3-SEC001", "(password|passwd|pwd)[ ]*[:=][ ]*[\"'][^\"']{4,}[\"']"), S.Rule("B3-SEC002", "(api[_-]?key|secret)[ ]*[:=][ ]*[\"'][^\"']{8,}[\"']"), S.Rule("B3-SEC003", "token[ ]*[:=][ ]*[\"'][A-Za-z0-9_.-]{16,}[\"']"), S.Rule("B3-SEC004", "AKIA[0-9A-Z]{16}"), S.Rule("B3-SEC005", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), S.Rule("B3-SEC006", "[a-z]+://[^ :/@]+:[^ :/@]+@")]
PII = [S.Rule("PII-MAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), S.Rule("PII-IP", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), S.Rule("PII-PHONE", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"), S.Rule("PII-CARD", "[0-9]{16}")]


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), "doc_id", "lang", "source", "text")


def _sql_rules(rules, text="line"):
    return "(VALUES " + ", ".join(f"('{r.check_id}', '{r.pattern.replace(chr(39), chr(39) * 2)}')" for r in rules) + ") r(rule_id, pattern)"


_LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, length(line)::BIGINT AS chars FROM {_LINES} WHERE trim(line) <> ''")
def scan_lines(spark, sf):
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text")
    return lines.where("trim(line) <> ''").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("chars"))


@query(f"SELECT doc_id, line_no::BIGINT AS line_no, rule_id FROM {_LINES} l, {_sql_rules(SECRETS + PII)} WHERE regexp_matches(line, '(?i)' || pattern)")
def rule_regex_scan(spark, sf):
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text")
    return S.evaluate_lines(lines, SECRETS + PII).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule_id")


@query(
    """SELECT doc_id, 'token' AS rule_id, length(pre) - length(replace(pre, chr(10), '')) + 1 AS line,
       length(pre) - coalesce(length(regexp_extract(pre, '(?s)^(.*\\n)', 1)), 0) + 1 AS "column", hit AS snippet
FROM (SELECT doc_id, hits[i] AS hit, array_to_string(list_slice(parts, 1, i), '') || array_to_string(list_slice(hits, 1, i - 1), '') AS pre0, i, parts, hits,
        array_to_string(list_transform(range(1, i + 1), lambda k: parts[k] || CASE WHEN k < i THEN hits[k] ELSE '' END), '') AS pre
      FROM (SELECT doc_id, regexp_extract_all(text, 'token = "[0-9a-f]+"') AS hits, string_split_regex(text, 'token = "[0-9a-f]+"') AS parts FROM documents) d, (SELECT unnest(range(1, 200)) AS i) n WHERE i <= len(hits)) x"""
)
def rule_match_columns(spark, sf):
    docs = table(spark, sf, "documents")
    return S.evaluate(docs, [S.Rule("token", 'token = "[0-9a-f]+"', ignore_case=False)], path="doc_id", basename=None, content="text").select(F.col("path").alias("doc_id"), "rule_id", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "snippet")


@query(f"SELECT rule_id, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM {_LINES} l, {_sql_rules(SECRETS)} WHERE regexp_matches(line, '(?i)' || pattern) GROUP BY rule_id")
def secret_scan(spark, sf):
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text")
    return S.evaluate_lines(lines, SECRETS).groupBy("rule_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("doc_id").alias("docs"))


@query(
    f"""WITH f AS (SELECT doc_id, lang, line_no, rule_id FROM {_LINES} l, {_sql_rules(SECRETS + PII)} WHERE regexp_matches(line, '(?i)' || pattern)),
s AS (SELECT *, CASE WHEN rule_id LIKE 'B3-%' THEN 'high' WHEN rule_id = 'PII-CARD' THEN 'high' ELSE 'medium' END AS severity FROM f)
SELECT lang, severity, count(*) AS findings, count(DISTINCT doc_id) AS docs, greatest(0, 100 - count(*) * CASE severity WHEN 'high' THEN 10 ELSE 5 END)::BIGINT AS score FROM s GROUP BY lang, severity"""
)
def secret_report(spark, sf):
    """The whole way: texts to lines, rules, exact deduplication, counts and a score by language and severity."""
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text", "lang")
    hits = S.evaluate_lines(lines, SECRETS + PII).select(F.col("doc_id").alias("file"), F.col("line_no").alias("line"), "rule_id", "lang", F.when(F.col("rule_id").startswith("B3-") | (F.col("rule_id") == "PII-CARD"), "high").otherwise("medium").alias("severity"), F.lit("rule").alias("engine"), F.lit("high").alias("confidence"), F.lit(0).alias("ord"))
    kept = N.exact_dedup(hits).where("kept")
    points = F.when(F.col("severity") == "high", 10).otherwise(5)
    return kept.groupBy("lang", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("docs"), F.sum(points).alias("_p")).select("lang", "severity", "findings", "docs", F.greatest(F.lit(0), 100 - F.col("_p")).cast("long").alias("score"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'))::BIGINT AS mails, len(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'))::BIGINT AS ips, len(regexp_extract_all(text, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'))::BIGINT AS phones, len(regexp_extract_all(text, '[0-9]{16}'))::BIGINT AS cards FROM documents""")
def pii_scan(spark, sf):
    n = lambda r: F.regexp_count("text", F.lit(r.pattern)).cast("long")
    return table(spark, sf, "documents").select("doc_id", *(n(r).alias(c) for r, c in zip(PII, ["mails", "ips", "phones", "cards"], strict=True)))


@query(f"SELECT doc_id, line_no::BIGINT AS line_no FROM {_LINES} WHERE regexp_matches(line, '(?i)licen[sc]ed? ')")
def license_header_scan(spark, sf):
    return X.to_lines(table(spark, sf, "documents"), "doc_id", "text").where(F.col("line").rlike("(?i)licen[sc]ed? ")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


_ABSENT = {"WEB-VIEWPORT": ["viewport"], "WEB-CSP": ["content-security-policy"], "WEB-NOOPENER": ["noopener", "noreferrer"], "WEB-CHARSET": ["charset"], "WEB-MAIN": ["<main", 'role="main"'], "WEB-LANG": ["lang="]}


@query(" UNION ALL ".join(f"SELECT page_id, '{k}' AS rule_id FROM pages WHERE {' AND '.join(f'NOT contains(lower(html), {chr(39)}{w}{chr(39)})' for w in ws)}" for k, ws in _ABSENT.items()))
def absence_rules(spark, sf):
    rules = [S.Rule(k, "", words=ws) for k, ws in _ABSENT.items()]
    return S.evaluate(table(spark, sf, "pages"), rules, path="page_id", basename=None, content="html").select(F.col("path").alias("page_id"), "rule_id")


@query("""SELECT g.pattern, count(*) AS pages FROM pages, (VALUES ('*.com/*', '^.*\\.com/.*$'), ('https://m.*', '^https://m\\..*$'), ('*/en/[0-4]*', '^.*/en/[0-4].*$'), ('*#top,*.org/?', '^(.*#top|.*\\.org/.)$')) g(pattern, re) WHERE regexp_matches(url, re) GROUP BY g.pattern""")
def glob_gate(spark, sf):
    globs = ["*.com/*", "https://m.*", "*/en/[0-4]*", "*#top,*.org/?"]
    hits = F.filter(F.array(*(F.when(F.col("url").rlike(X.glob_regex(g)), F.lit(g)) for g in globs)), lambda x: x.isNotNull())
    return table(spark, sf, "pages").select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"))


@query("""SELECT r.rule_id FROM (VALUES ('R-ALL', NULL), ('R-EN', ['en']), ('R-ZH', ['zh', 'ja']), ('R-DEFR', ['de', 'fr']), ('R-NONE', [])) r(rule_id, langs) WHERE r.langs IS NULL OR len(r.langs) = 0 OR EXISTS (SELECT 1 FROM documents d WHERE list_contains(r.langs, d.lang))""")
def rule_pruning(spark, sf):
    rules = spark.createDataFrame([("R-ALL", None), ("R-EN", ["en"]), ("R-ZH", ["zh", "ja"]), ("R-DEFR", ["de", "fr"]), ("R-NONE", [])], "rule_id string, languages array<string>")
    langs = table(spark, sf, "documents").select(F.col("lang").alias("language")).where("language is not null").distinct()
    return S.prune(rules, langs).select("rule_id")


@query("""SELECT ext, count(*) AS files FROM (SELECT CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.ts' ELSE '.txt' END AS ext FROM documents) WHERE ext IN ('.py', '.js', '.ts') GROUP BY ext""")
def extension_filter(spark, sf):
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".ts").otherwise(".txt")
    return table(spark, sf, "documents").select(ext.alias("ext")).where(corpus.extension_filter(F.col("ext"), [".py", ".js", ".ts"])).groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT doc_id, (contains(lower(path), '/src1/') OR contains(lower(path), 'src7') OR contains(lower(path), 'vendor')) AS removed, CASE WHEN (contains(lower(path), '/src1/') OR contains(lower(path), 'src7') OR contains(lower(path), 'vendor')) THEN 'path' END AS reason FROM (SELECT doc_id, 'corpus/' || source || '/' || doc_id AS path FROM documents)""")
def whitelist_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return N.split_by(docs, N.path_contains(F.col("path"), ["/src1/", "src7", "vendor"]), "path").select("doc_id", "removed", "reason")


@query("""SELECT doc_id FROM documents WHERE len(list_filter(list_slice(string_split(text, chr(10)), 1, 10), lambda l: contains(lower(l), 'licensed under') OR contains(lower(l), 'released under'))) > 0""")
def autogen_marker(spark, sf):
    return table(spark, sf, "documents").where(N.marked_generated(F.col("text"), ["licensed under", "released under"])).select("doc_id")


@query(
    f"""SELECT doc_id, line_no::BIGINT AS line_no, CASE WHEN own THEN 'line' WHEN prev THEN 'previous' ELSE 'none' END AS how FROM (
SELECT doc_id, line_no, line, contains(line, '%%%') AS own, coalesce(lag(contains(line, '###')) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS prev FROM {_LINES}) WHERE contains(line, 'token') OR contains(line, '***')"""
)
def suppression_line_prev(spark, sf):
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    prev = F.coalesce(F.lag(F.col("line").contains("###")).over(w), F.lit(False))
    how = F.when(F.col("line").contains("%%%"), "line").when(F.col("prev"), "previous").otherwise("none")
    return lines.withColumn("prev", prev).where(F.col("line").contains("token") | F.col("line").contains("***")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), how.alias("how"))


@query(
    """SELECT event_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth
FROM (SELECT event_id, user_id, ts, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)"""
)
def suppression_block_depth(spark, sf):
    events = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return N.depths(events, F.col("event_type").isin("signup", "view"), F.col("event_type").isin("error", "purchase"), "user_id", "at").select("event_id", F.col("depth").cast("long").alias("depth"))


_SUPPRESSED = [("a.py", "# qa-ignore-file: F1, F2\nx = 1\n# qa-ignore: R1 - why not\ny = 2\nz = 3  # qa-ignore: R2,R3\n# qa-ignore-begin\nq = 4\n# qa-ignore-end\nr = 5\n# qa-nosonar\ns = 6"), ("b.py", "# qa-ignore-end\na = 1\n# qa-ignore-begin\n# qa-ignore-begin\nb = 2\n# qa-ignore-end\nc = 3\n# qa_ignore_end\nd = 4  # qa-ignore: all\n\n# qa-ignore-file: F9"), ("d/c.js", "// qa-ignore-all\nfoo();")]


@query("""SELECT * FROM (VALUES ('a.py', 2, 'F1', 'file'), ('a.py', 4, 'R1', 'line'), ('a.py', 4, 'R2', NULL), ('a.py', 5, 'R3', 'line'), ('a.py', 7, 'R1', 'block'), ('a.py', 9, 'R1', NULL), ('a.py', 11, 'R9', 'line'), ('b.py', 2, 'R1', NULL), ('b.py', 5, 'R1', 'block'), ('b.py', 7, 'R1', 'block'), ('b.py', 9, 'R1', 'line'), ('b.py', 10, 'F9', NULL), ('d/c.js', 2, 'R1', 'file'), ('d/c.js', 2, 'G1', 'global'), ('d/x.js', 1, 'D1', 'directory')) t(file, line, rule_id, suppress_type)""")
def suppression_ladder(spark, sf):
    """Findings of three small files against every kind of suppression."""
    files = spark.createDataFrame(_SUPPRESSED, "path string, content string")
    found = spark.createDataFrame([("a.py", 2, "F1"), ("a.py", 4, "R1"), ("a.py", 4, "R2"), ("a.py", 5, "R3"), ("a.py", 7, "R1"), ("a.py", 9, "R1"), ("a.py", 11, "R9"), ("b.py", 2, "R1"), ("b.py", 5, "R1"), ("b.py", 7, "R1"), ("b.py", 9, "R1"), ("b.py", 10, "F9"), ("d/c.js", 2, "R1"), ("d/c.js", 2, "G1"), ("d/x.js", 1, "D1")], "file string, line int, rule_id string")
    return N.suppress(found, N.suppressions(files), skip=["G1"], directories=spark.createDataFrame([("d", "D1")], "directory string, rule_id string"))


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '"k": ?[0-4]?[0-9]\\}') AND event_type = 'error' THEN 'info' WHEN event_type = 'error' THEN 'problem' ELSE 'suggestion' END AS level FROM events""")
def fp_todo_downgrade(spark, sf):
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "problem").otherwise("suggestion")
    rule = F.when(F.col("event_type") == "error", "14.1").otherwise("5.5")
    small = F.when(F.col("props").rlike('"k": ?[0-4]?[0-9]\\}'), F.lit("TODO #1")).otherwise("")
    return e.select("event_id", N.downgraded(level, rule, small, F.lit("")).alias("level"))


_ABBR = "(?i)\\b(" + "|".join(N.ABBREVIATIONS) + ")\\b"


@query(f"SELECT p_partkey, regexp_matches(p_type || ' ' || p_name, '{_ABBR}') AS fp FROM (SELECT p_partkey, p_type, p_name FROM part UNION ALL SELECT -1, 'API key', 'x')")
def fp_abbrev(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_name").union(spark.createDataFrame([(-1, "API key", "x")], "a long, b string, c string"))
    return parts.select("p_partkey", N.false_positive(F.lit("NAME-001"), F.lit(""), F.concat_ws(" ", "p_type", "p_name")).isNotNull().alias("fp"))
