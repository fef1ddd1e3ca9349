"""Queries about projects: kinds, frameworks, manifests, resources, names, rules; over small corpora given as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.operators import crossfile as C
from sieveworks.operators import facts as A
from sieveworks.operators import graph as G
from sieveworks.operators import history as H
from sieveworks.operators import profile as R
from sieveworks.operators import score as P
from sieveworks.plans.base import query, table
from sieveworks.plans.contexts import pick
from sieveworks.sources import corpus
from sieveworks.sources import rules as L

_PROJECTS = [
    ("shop", "app.py", "from flask import Flask\napp.run()\n"), ("shop", "index.html", "<p>"), ("tool", "main.py", "import argparse\n"), ("site", "App.vue", ""), ("site", "index.html", ""), ("both", "App.tsx", ""), ("both", "api.py", "import fastapi"),
    ("desk", "package.json", '{"devDependencies": {"electron": "1"}}'), ("desk", "main.js", "const e = require('electron')"), ("mini", "app.json", '{"pages": []}'), ("mini", "x.wxml", ""), ("skill", "SKILL.md", ""), ("none", "notes.txt", ""), ("serve", "s.py", "uvicorn.run(app)"),
]


@query("SELECT * FROM (VALUES ('shop', 'flask'), ('tool', 'python_tool'), ('site', 'web'), ('both', 'mixed'), ('desk', 'electron'), ('mini', 'miniprogram'), ('skill', 'skill'), ('none', 'unknown'), ('serve', 'python_backend')) t(project, kind)")
def project_types(spark, sf):
    rows = spark.createDataFrame(_PROJECTS, "project string, basename string, content string")
    out = None
    for name in sorted({p[0] for p in _PROJECTS}):  # a handful of projects, each a corpus of its own
        one = R.project_flags(rows.where(F.col("project") == name)).select(F.lit(name).alias("project"), R.project_type().alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT type, framework, score::DOUBLE AS score FROM (VALUES ('backend', 'flaskish', 0.475), ('frontend', 'vueish', 0.8889)) t(type, framework, score)")
def framework_detection(spark, sf):
    signatures = spark.createDataFrame([("flaskish", "backend", 1.0, "file", "wsgi.py"), ("flaskish", "backend", 1.0, "import", r"from flask import"), ("flaskish", "backend", 1.0, "dep", "flask"), ("flaskish", "backend", 1.0, "ext", ".py"), ("vueish", "frontend", 1.0, "ext", ".vue"), ("vueish", "frontend", 1.0, "file", "vite.config.js"), ("vueish", "frontend", 1.0, "dep", "Vue"), ("other", "frontend", 1.0, "dep", "react")], "framework string, type string, weight double, kind string, word string")
    files = spark.createDataFrame([("wsgi.py", "from flask import x")] + [("c.vue", "")] * 5 + [("vite.config.js", "")], "basename string, content string")
    deps = spark.createDataFrame([("vue",), ("numpy",)], "name string")
    best = R.best_per_type(R.framework_scores(files, signatures, deps))
    return best.select("type", "framework", F.round("score", 4).alias("score"))


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'DEP-CFG-008' ELSE 'DEP-CFG-007' END AS rule_id, 's' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 IN (0, 1)")
def manifest_checks(spark, sf):
    """Requirements without a version, and versions that float: manifests made of suppliers."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_suppkey")
    req = corpus.requirements(s.select("path", F.expr("'# list' || char(10) || 's' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '==1.0' END || char(10) || '-r more'").alias("content")))
    pkg = corpus.package_dependencies(s.select("path", F.expr("""'{"dependencies": {"s' || s_suppkey || '": "' || CASE WHEN s_suppkey % 3 = 1 THEN '^' ELSE '' END || '1.0"}}'""").alias("content")))
    return req.where("not pinned").select(F.lit("DEP-CFG-008").alias("rule_id"), "name").unionByName(pkg.where("version like '^%'").select(F.lit("DEP-CFG-007").alias("rule_id"), "name"))


#: Files in Python made of parts: what they open, loop over, import and define depends on the part's numbers.
_FILE = "'import os' || chr(10) || 'import json, sys as system' || chr(10) || 'print(os.name, system' || CASE WHEN p_size % 3 = 0 THEN ', json' ELSE '' END || ')' || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'f = open(\"x\")' ELSE 'with open(\"x\") as f:' || chr(10) || '    pass' END || chr(10) || 'for r in rows:' || chr(10) || CASE WHEN p_size % 4 < 2 THEN '    cur.execute(q)' ELSE '    cur.close()' END || chr(10) || 'def save' || (p_partkey % 40) || '(x):' || chr(10) || '    return x' || chr(10)"
_LOOP = "(5 + p_size % 2)"


def _files(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_FILE.replace("chr(10)", "char(10)")).alias("content"))


@query("SELECT p_partkey::VARCHAR AS path, 4 AS line, 'open' AS name FROM part WHERE p_size % 2 = 0")
def unclosed_resources(spark, sf):
    return A.unclosed(A.python_facts(_files(spark, sf), kinds=("call", "with", "try")), ["open"])


@query(f"SELECT p_partkey::VARCHAR AS path, {_LOOP} + 1 AS line, 'cur.execute' AS name, {_LOOP} AS loop_line FROM part WHERE p_size % 4 < 2")
def queries_in_loops(spark, sf):
    return A.calls_in_loops(A.python_facts(_files(spark, sf), kinds=("call",)), ["execute", "fetch"])


@query("SELECT p_partkey::VARCHAR AS path, 'json' AS name FROM part WHERE p_size % 3 <> 0")
def unused_imports(spark, sf):
    files = _files(spark, sf)
    return A.unused_imports(A.python_facts(files, kinds=("import",)), files)


@query("SELECT 'save' || (p_partkey % 40) AS name, count(*) AS files, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS paths FROM part GROUP BY 1 HAVING count(*) > 1")
def shared_function_names(spark, sf):
    names = A.python_facts(_files(spark, sf), kinds=("function",))
    return C.shared_names(names).select("name", "files", F.array_join("paths", ",").alias("paths"))


@query("SELECT 'x.js' AS path, 'a,b,c' AS shape, 3::BIGINT AS n")
def repeated_object_shapes(spark, sf):
    files = spark.createDataFrame([("x.js", "f({a: 1, b: 2, c: 3}); g({c: 1, a: 2, b: 3});\nh({'b': 1, 'a': 0, \"c\": 2}); k({a: 1, b: 2});")], "path string, content string")
    return C.object_shapes(files, "path", "content")


_DIR = pick("p_partkey", ["'src/domain'", "'src/api/domain'", "'src/web_api'", "'src/infra/db'", "'plain'", "'src/domain/views'", "'old_services'"])


@query(f"SELECT 'r/' || ({_DIR}) || '/f' || p_partkey || '.py' AS path, CASE p_partkey % 7 WHEN 0 THEN 'domain' WHEN 1 THEN 'domain' WHEN 2 THEN 'interface' WHEN 3 THEN 'infrastructure' WHEN 5 THEN 'interface' ELSE 'application' END AS layer FROM part WHERE p_partkey % 7 <> 4")
def layer_detection(spark, sf):
    return G.layers_of(table(spark, sf, "part").select(F.expr(f"'r/' || ({_DIR}) || '/f' || p_partkey || '.py'").alias("path")))


@query("SELECT event_type AS engine, round(avg(user_id % 10) / 10.0, 6) AS accuracy, count(*) AS n FROM events WHERE event_id % 20 = 3 GROUP BY event_type HAVING avg(user_id % 10) >= 4.5")
def engine_route(spark, sf):
    """Engines that did well on similar tasks: event types on the tasks of one remainder."""
    past = table(spark, sf, "events").where("event_id % 20 = 3").select(F.col("event_type").alias("engine"), (F.col("user_id") % 10 / 10.0).alias("accuracy"))
    return H.route(past, least_accuracy=0.45 - 1e-9).select("engine", F.round("accuracy", 6).alias("accuracy"), "n")


@query("SELECT 'semgrep' AS engine, 0 AS place UNION ALL SELECT 'rule', 1 UNION ALL SELECT 'deps', 2")
def engine_budget(spark, sf):
    chosen = H.within_budget([("rule", 0.02), ("ai", 0.5), ("semgrep", 0.01), ("deps", 0.03)], 0.1)
    return spark.createDataFrame([(e, i) for i, e in enumerate(chosen)], "engine string, place int")


@query("SELECT floor(avg(score))::BIGINT AS score FROM (SELECT event_type, least(100, count(*) % 101)::BIGINT AS score FROM events WHERE event_type <> 'error' GROUP BY event_type)")
def mean_engine_score(spark, sf):
    runs = table(spark, sf, "events").groupBy("event_type").agg((F.count(F.lit(1)) % 101).alias("score")).withColumn("status", F.when(F.col("event_type") == "error", "error").otherwise("pass"))
    return P.mean_engine_score(runs).select(F.col("score").cast("long").alias("score"))


_RULE = "'R-' || p_partkey || CASE p_size % 5 WHEN 0 THEN '-SEMG' WHEN 1 THEN '-semg' ELSE '' END"


@query(f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'regex' WHEN p_partkey % 7 IN (1, 2, 3, 4) OR p_size % 5 IN (0, 1) THEN 'semgrep' ELSE 'semantic' END AS rule_type, CASE p_partkey % 6 WHEN 0 THEN 'blocker' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'blocker' ELSE 'odd' END AS severity FROM part")
def rule_classification(spark, sf):
    """Rules made of parts: a pattern, a field that names a semantic one, such an id, or nothing."""
    from sieveworks.schema import severity_name

    field = lambda name, k: F.when(F.col("p_partkey") % 7 == k, F.col("p_name")).alias(name)
    severity = F.element_at(F.array(*(F.lit(x) for x in ("S1", "S2", "S3", "S4", "critical", "odd"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_RULE).alias("check_id"), F.lit(None).cast("string").alias("id"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("pattern"), field("detection_pattern", 1), field("semgrep_id", 2), field("semgrep_rule", 3), field("semgrep_rule_id", 4), severity.alias("severity"))
    return rows.select("p_partkey", L.rule_type().alias("rule_type"), severity_name(F.col("severity")).alias("severity"))


@query("SELECT lang, shelf, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id::VARCHAR) AS ids FROM (SELECT doc_id, lang, doc_id // 50 AS shelf FROM documents) GROUP BY lang, shelf")
def joined_contents(spark, sf):
    """Contents of shelves of 50 paths in the order of the paths, as the files of one root are read whole."""
    d = table(spark, sf, "documents").select("lang", F.expr("doc_id div 50").alias("shelf"), F.col("doc_id").cast("string").alias("path"))
    return corpus.joined_content(d.withColumn("content", F.col("path")), "path", "content", "lang", "shelf").select("lang", "shelf", F.translate("content", "\n", " ").alias("ids"))
