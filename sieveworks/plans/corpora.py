"""Queries across files: duplication, linkage, graphs, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions import text as X
from sieveworks.operators import crossfile as C
from sieveworks.operators import facts as A
from sieveworks.operators import graph as G
from sieveworks.operators import profile as R
from sieveworks.plans.base import query, table

_CODE = "(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS line_no, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE line <> '' AND NOT regexp_matches(line, '^(#|//|/[*]|[*])'))"
_SHINGLE = "md5(line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w || chr(10) || lead(line, 3) OVER w || chr(10) || lead(line, 4) OVER w)"


def _code(spark, sf):
    return C.code_lines(table(spark, sf, "documents"), "doc_id", "text")


@query(
    f"""WITH l AS {_CODE}, s AS (SELECT doc_id, line_no, {_SHINGLE} AS h FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
c AS (SELECT h FROM s WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT DISTINCT doc_id, line_no + k AS line_no FROM s JOIN c USING (h), range(5) r(k))
SELECT (SELECT count(*) FROM l) AS total_lines, (SELECT count(*) FROM m) AS dup_lines, round((SELECT count(*) FROM m) / (SELECT count(*) FROM l), 6) AS dup_rate"""
)
def dup_code_rate(spark, sf):
    return C.duplicate_rate(_code(spark, sf)).select("total_lines", "dup_lines", F.round("dup_rate", 6).alias("dup_rate"))


_MASK = "regexp_replace(line, '\\b[a-zA-Z_][a-zA-Z0-9_]{2,}\\b', 'VAR', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id, line_no, regexp_replace(line, '[a-zA-Z]{{3,}}', 'VAR', 'g') AS line FROM {_CODE}), s AS (SELECT doc_id, line_no, line || '|' || lead(line, 1) OVER w || '|' || lead(line, 2) OVER w AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT md5(left(b, 200)) AS block_key, count(*) AS n FROM s WHERE b IS NOT NULL AND (line_no - 1) % 2 = 0 GROUP BY 1 HAVING count(*) > 1"""
)
def similar_blocks(spark, sf):
    """Blocks of three lines, each two lines, equal but for runs of three letters or more, which both engines see alike."""
    lines = _code(spark, sf).withColumn("line", F.regexp_replace("line", "[a-zA-Z]{3,}", "VAR"))
    masked = lines.withColumn("line", F.col("line"))
    w = X.Window.partitionBy("path").orderBy("line_no")
    block = F.concat_ws("|", "line", F.lead("line", 1).over(w), F.lead("line", 2).over(w))
    b = masked.withColumn("b", block).withColumn("z", F.lead("line", 2).over(w)).where(F.col("z").isNotNull() & ((F.col("line_no") - 1) % 2 == 0))
    return b.groupBy(F.md5(F.substring("b", 1, 200)).alias("block_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"SELECT line, count(*) AS n FROM {_CODE} GROUP BY line HAVING count(*) > 3")
def repeated_lines(spark, sf):
    return C.repeated(_code(spark, sf), "line", 3)


@query("SELECT literal, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[\"'']([^\"''\n]{5,})[\"'']', 1)) AS literal FROM pages) GROUP BY literal HAVING count(*) > 3")
def repeated_literals(spark, sf):
    return C.repeated(C.literals(table(spark, sf, "pages"), "html"), "literal", 3)


@query("SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines, len(regexp_extract_all(text, '[^ \n]+'))::BIGINT AS words, n_chars = length(text) AS ok FROM documents")
def doc_length_profile(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines"), F.regexp_count(t, F.lit("[^ \n]+")).cast("long").alias("words"), (F.col("n_chars") == F.length(t)).alias("ok"))


_L = "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(
    f"""SELECT source, count(DISTINCT doc_id) AS files, count(*) AS lines, count(*) FILTER (trim(line) <> '' AND NOT c) AS code_lines, count(*) FILTER (trim(line) <> '' AND c) AS comment_lines, count(*) FILTER (regexp_matches(line, '\\b(TODO|FIXME|HACK|XXX)\\b')) AS tasks
FROM (SELECT *, regexp_matches(ltrim(line), '^(#|//|/[*]|[*])') AS c FROM {_L}) GROUP BY source"""
)
def corpus_ratios(spark, sf):
    return R.ratios(table(spark, sf, "documents"), "doc_id", "text", "source").select("source", "files", "lines", "code_lines", "comment_lines", "tasks")


@query(
    f"""WITH r AS (SELECT source, count(DISTINCT doc_id) AS files, count(*) FILTER (trim(line) <> '') AS code, count(*) FILTER (contains(line, '###')) AS tasks FROM {_L} GROUP BY source),
s AS (SELECT *, tasks * 1000.0 / greatest(1, code) AS density FROM r), e AS (SELECT source, code, (CASE WHEN density > 5 THEN 2 WHEN density > 2 THEN 1 ELSE 0 END + CASE WHEN code < 3000 AND files < 20 THEN 2 WHEN code < 8000 AND files < 50 THEN 1 ELSE 0 END + CASE WHEN files < 50 THEN 1 ELSE 0 END)::BIGINT AS early FROM s)
SELECT source, early, CASE WHEN early >= 3 AND code < 10000 THEN 'early' ELSE 'mature' END AS stage, CASE WHEN early >= 3 AND code < 10000 THEN 120 ELSE 80 END::BIGINT AS longest FROM e"""
)
def maturity_score(spark, sf):
    lines = X.to_lines(table(spark, sf, "documents"), "doc_id", "text", "source")
    r = lines.groupBy("source").agg(F.countDistinct("doc_id").alias("files"), F.count(F.when(F.trim("line") != "", 1)).alias("code"), F.count(F.when(F.col("line").contains("###"), 1)).alias("tasks"))
    early = R.early_score(F.col("tasks") * 1000.0 / F.greatest(F.lit(1), F.col("code")), F.lit(0.0), F.col("code"), F.col("files"), F.col("files") < 50)
    stage = R.stage(F.col("early"), F.col("code"))
    return r.withColumn("early", early.cast("long")).select("source", "early", stage.alias("stage"), R.threshold(stage, "function_lines", 80).cast("long").alias("longest"))


@query("SELECT o_orderkey AS domain, o_custkey AS action FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 3 = o_custkey % 3)")
def orphan_keys(spark, sf):
    """Routes (order, class of customer) that no call (line, class of supplier) names."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("domain"), F.col("o_custkey").alias("cust"), (F.col("o_custkey") % 3).alias("action"))
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("domain"), (F.col("l_suppkey") % 3).alias("action"))
    return C.orphans(o, calls).select("domain", F.col("cust").alias("action"))


@query("SELECT DISTINCT l_orderkey AS domain, l_suppkey % 3 AS action FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND l_suppkey % 3 = o_custkey % 3)")
def ghost_keys(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("domain"), (F.col("o_custkey") % 3).alias("action"))
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("domain"), (F.col("l_suppkey") % 3).alias("action"))
    return C.ghosts(o, calls).select("domain", "action")


@query("SELECT count(*) AS calls, count(*) FILTER (hit) AS answered, round(count(*) FILTER (hit) * 100.0 / count(*), 6) AS coverage FROM (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS a, EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey AND l_suppkey % 3 = o_custkey % 3) AS hit FROM lineitem)")
def key_coverage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("domain"), (F.col("o_custkey") % 3).alias("action"))
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("domain"), (F.col("l_suppkey") % 3).alias("action"))
    return C.coverage(o, calls).select("calls", "answered", F.round("coverage", 6).alias("coverage"))


@query("SELECT DISTINCT a.n_name AS left_name, b.m AS right_name FROM nation a JOIN (SELECT replace(n_name, ' ', '-') AS m FROM nation UNION SELECT lower(n_name) FROM nation) b ON lower(replace(replace(a.n_name, ' ', '_'), '-', '_')) = lower(replace(replace(b.m, ' ', '_'), '-', '_')) WHERE a.n_name <> b.m")
def near_name_join(spark, sf):
    n = table(spark, sf, "nation").select("n_name")
    other = n.select(F.regexp_replace("n_name", " ", "-").alias("n_name")).union(n.select(F.lower("n_name")))
    return C.near_names(n, other, "n_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size > 10")
def dep_multi_anti(spark, sf):
    parts = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("module"), "p_partkey")
    li = table(spark, sf, "lineitem")
    known = lambda c: li.where(c).select(F.col("l_partkey").cast("string").alias("module"))
    return C.undeclared(parts, known("l_returnflag = 'R'"), known("l_quantity > 45")).select("p_partkey")


_LAYER_SQL = "(VALUES ('AFRICA', 0), ('AMERICA', 1), ('ASIA', 2), ('EUROPE', 3), ('MIDDLE EAST', 4)) k(r_name, rank)"


@query(f"SELECT count(*) AS edges, a.r_name AS src_layer, b.r_name AS dst_layer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region a ON cn.n_regionkey = a.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region b ON sn.n_regionkey = b.r_regionkey JOIN {_LAYER_SQL} ON k.r_name = a.r_name JOIN {_LAYER_SQL.replace(' k(', ' m(')} ON m.r_name = b.r_name WHERE k.rank < m.rank GROUP BY 2, 3")
def layer_violation(spark, sf):
    """Edges from customers to suppliers, with regions for layers."""
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    nation = table(spark, sf, "nation").join(F.broadcast(region), "n_regionkey")
    cust = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("r_name").alias("layer"))
    supp = table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("r_name").alias("layer"))
    edges = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    ranks = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}
    return G.violations(edges, cust.unionByName(supp), ranks).groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("edges"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation), r AS (SELECT 0 AS start, 0 AS node UNION SELECT 1, 1 UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start::BIGINT AS start, node::BIGINT AS node FROM r")
def reachability(spark, sf):
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst")).union(n.select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")))
    return G.reachable(edges, spark.createDataFrame([(0,), (1,)], "node long")).select("start", "node")


@query("WITH c AS (SELECT source AS category, 40::BIGINT AS quantity FROM documents GROUP BY source), a AS (SELECT source AS category, count(*) AS actual FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT category, quantity, actual FROM c JOIN a USING (category) WHERE actual < quantity * 0.5 OR actual > quantity * 2.0")
def claim_vs_actual(spark, sf):
    d = table(spark, sf, "documents")
    claims = d.select(F.col("source").alias("category"), F.lit(40).cast("long").alias("quantity")).distinct()
    counts = d.join(table(spark, sf, "labels"), "doc_id").groupBy(F.col("source").alias("category")).agg(F.count(F.lit(1)).alias("actual"))
    return C.claims_against(claims, counts)


_W = "list_filter(string_split_regex(lower(text), '[^a-z0-9à-ÿ]+'), lambda w: w <> '')"
_G = "(SELECT {k}, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')))) AS gram FROM (SELECT {k}, " + _W + " AS w FROM {t}))"


@query(f"SELECT doc_id AS key, item_id AS ref_key, count(*) AS shared FROM {_G.format(k='doc_id', t='documents')} a JOIN {_G.format(k='item_id', t='benchmark')} b USING (gram) GROUP BY ALL")
def contamination_ngrams(spark, sf):
    return C.ngram_overlap(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", 8)


@query("SELECT lang, count(*) AS n, sum(CASE WHEN t % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS odd FROM (SELECT lang, len(string_split(text, '\"')) - 1 AS t FROM documents) GROUP BY lang")
def quote_parity(spark, sf):
    """Documents with an odd number of quotes, as parity checks of open strings count them."""
    t = F.size(F.split("text", '"', -1)) - 1
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((t % 2 == 1).cast("long")).alias("odd"))


_SNIPPETS = [
    ("db.py", "import os, random\nfrom pickle import *\nfrom app.models import User\n\ndef find(cur, name, cache={}):\n    for n in name:\n        cur.execute(f\"select {n}\")\n    try:\n        cur.execute('a' + name)\n    except:\n        pass\n    try:\n        return 1\n    except Exception as e:\n        x = e\n\nDEBUG = True\napi_key = 'abcdef'\ntoken = random.random()\n"),
    ("clean.py", "import os\n\ndef area(a, b):\n    if a and b:\n        return a * b\n    return os.getcwd()\n\nclass Box(object):\n    def open(self):\n        try:\n            return self.x\n        except Exception:\n            raise\n"),
    ("bad.py", "def broken(:\n"),
    ("run.py", "import pickle, marshal\nfrom .db import find\n\nasync def go(p, q=[], *, r={}):\n    eval(p)\n    pickle.loads(q)\n    marshal.loads(r)\n    open(f'/tmp/{p}')\n    try:\n        f = open('x' + p)\n    except Exception:  # noqa\n        pass\n    finally:\n        pass\n"),
]


def _snippets(spark):
    return spark.createDataFrame(_SNIPPETS, "path string, content string")


@query(
    "SELECT * FROM (VALUES ('db.py', 'SEC-SQLI-001', 7), ('db.py', 'SEC-SQLI-003', 9), ('db.py', 'B3-EXCEPT-001', 10), ('db.py', 'B3-EXCEPT-003', 10), ('db.py', 'B3-EXCEPT-002', 14), ('db.py', 'SEC-DEBUG-001', 17), ('db.py', 'SEC-066', 18), ('db.py', 'SEC-RAND-001', 19), ('db.py', 'CQ-IMPORT-001', 2), ('db.py', 'B3-DEFAULT-001', 5), "
    "('run.py', 'B3-DEFAULT-001', 4), ('run.py', 'B3-DEFAULT-001', 4), ('run.py', 'SEC-EVAL-001', 5), ('run.py', 'SEC-DESER-001', 6), ('run.py', 'SEC-DESER-004', 7), ('run.py', 'SEC-PATH-001', 8), ('run.py', 'SEC-PATH-002', 10)) t(path, rule_id, line)"
)
def python_ast_checks(spark, sf):
    """Checks over the facts of a few small files."""
    return A.python_checks(A.python_facts(_snippets(spark))).select("path", "rule_id", "line")


@query("SELECT * FROM (VALUES ('db.py', 1, 0, 4, 3, 6), ('clean.py', 2, 1, 1, 1, 3), ('run.py', 1, 0, 3, 5, 3), ('bad.py', 0, 0, 0, 0, 0)) t(path, functions, classes, imports, calls, max_complexity)")
def python_ast_facts(spark, sf):
    s = A.summary(A.python_facts(_snippets(spark)))
    return s.select("path", "functions", "classes", "imports", "calls", "max_complexity")


@query("SELECT 'run.py' AS src, 'db.py' AS dst")
def import_graph(spark, sf):
    files = _snippets(spark)
    facts = A.python_facts(files).where("kind = 'import'").select("path", F.col("name").alias("module"), F.col("n").alias("level"))
    return G.import_edges(facts, files)


_SCRIPTS = [("a.tsx", "// @ts-ignore\nconst x: any = load('== eval(') as any;\nif (x == 1) { }\nconsole.log(x!.y);\nfunction C() {\n  useEffect(() => {\n    go(x);\n  });\n  useEffect(async () => { await go(); }, [x]);\n  const [s] = useState(make(1));\n  if (x) useMemo(() => x, [x]);\n}\n/* eval(x) */ eval(x);\n")]


@query("SELECT * FROM (VALUES ('TS-003', 1), ('TS-001', 2), ('JS-002', 3), ('JS-005', 3), ('JS-004', 4), ('TS-002', 4), ('HOOKS-003', 6), ('HOOKS-007', 9), ('HOOKS-008', 10), ('HOOKS-002', 11), ('JS-003', 13)) t(rule_id, line)")
def script_checks(spark, sf):
    lines = A.script_lines(spark.createDataFrame(_SCRIPTS, "path string, content string"))
    return A.script_checks(lines).select("rule_id", "line")
