"""Rules, patterns, catalogs and sources."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import text as X
from sieveworks.operators import scan as S
from sieveworks.sources import corpus, rules

FILES = [("src/a.py", "a.py", "x = eval(y)\nimport os\n  eval (z)\n"), ("web/b.js", "b.js", "let a = 1;\nfetch(u).then(f)\n"), ("web/c.ts", "c.ts", "const été = eval(1);"), ("Dockerfile.dev", "Dockerfile.dev", "FROM x:latest\n"), ("e.py", "e.py", "")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, basename string, content string")


def expected(rule):
    """By Python's own engine."""
    out = set()
    globs = re.compile(X.glob_regex(rule.file_pattern))
    for path, name, content in FILES:
        if globs.match(name):
            for m in re.finditer(rule.pattern, content, re.M | re.I):
                if m.end() > m.start():
                    line = content.count("\n", 0, m.start()) + 1
                    out.add((path, rule.check_id, line, m.start() - content.rfind("\n", 0, m.start()), m.group()[:100]))
    return out


RULES = [S.Rule("R1", r"\beval\s*\(", file_pattern="*.py"), S.Rule("R2", r"(?<!await )fetch\([^)]*\)", file_pattern="*.js, *.ts"), S.Rule("R3", r"^FROM .*:latest$", file_pattern="Dockerfile*"), S.Rule("R4", r"\w+té", file_pattern="*"), S.Rule("R5", r"z*", file_pattern="*.py"), S.Rule("R6", r"(?<=a|bc)\s=", file_pattern="*.js"), S.Rule("R7", r"^\s*import\s+(?P<m>\w+)")]


def test_rules_match_like_python(files):
    got = {tuple(r) for r in S.evaluate(files, RULES).collect()}
    want = set()
    for r in RULES:
        if r.check_id != "R6":
            want |= expected(r)
    assert {g for g in got if g[1] != "R6"} == want


def test_absence_rule_needs_all_words_missing(files):
    rule = S.Rule("A1", r"(?![\s\S]*(?:helmet|then))", file_pattern="*.js,*.ts")
    assert rule.words == ["helmet", "then"]
    assert [r[0] for r in S.evaluate(files, [rule]).collect()] == ["web/c.ts"]


@pytest.mark.parametrize("glob, name, hit", [("*.py", "a.py", True), ("*.py", "a.pyc", False), ("Dockerfile*", "Dockerfile.dev", True), ("*.js, *.ts", "x.ts", True), ("[ab]?.c", "b1.c", True), ("[!ab].c", "a.c", False), ("**/x.js", "p/q/x.js", True), ("**/x.js", "x.js", True), ("a.b", "aXb", False)])
def test_globs(glob, name, hit):
    assert bool(re.match(X.glob_regex(glob), name)) == hit


def test_strict_globs_take_a_comma_list_as_one(files):
    assert S.evaluate(files, [RULES[1]], strict_globs=True).count() == 0


def test_slow_patterns_are_stopped(spark):
    slow = spark.createDataFrame([("a", "a" * 40 + "!")], "path string, content string")
    assert S.guarded_matches(slow, 0, S.Rule("SLOW", r"(a|aa|aaa)*(a|aa)*(aaa|aa)*b", ignore_case=False), limit=0.2).count() == 0


def test_no_rules_give_no_rows(files):
    assert S.evaluate(files, []).count() == 0


def test_catalog_from_files(spark, tmp_path):
    good = [{"check_id": "X-1", "name": "one", "severity": "critical", "category": "security", "pattern": "eval", "file_pattern": "*.py"}, {"id": "X-2", "severity": "low", "applicable_files": ["*.js", "*.ts"], "pattern": "fetch"}, {"id": "X-3-semg", "severity": "S2"}, {"id": "X-4"}]
    (tmp_path / "sec").mkdir()
    (tmp_path / "_old").mkdir()
    (tmp_path / "sec" / "a.json").write_text(json.dumps(good))
    (tmp_path / "sec" / "b.json").write_text(json.dumps({"rules": [{"check_id": "X-1", "pattern": "os"}]}))
    (tmp_path / "_old" / "c.json").write_text(json.dumps([{"check_id": "OLD", "pattern": "x"}]))
    table = rules.read_rules(spark, str(tmp_path))
    rows = {(r["check_id"], r["path"].rsplit("/", 1)[-1]): r for r in table.collect()}
    assert {k[0] for k in rows} == {"X-1", "X-2", "X-3-semg", "X-4"}
    assert rows["X-1", "a.json"]["severity"] == "blocker" and rows["X-1", "a.json"]["level"] == "blocking"
    assert rows["X-2", "a.json"]["file_pattern"] == "*.js,*.ts" and rows["X-2", "a.json"]["level"] == "suggestion"
    assert [rows[k, "a.json"]["rule_type"] for k in ("X-1", "X-3-semg", "X-4")] == ["regex", "semgrep", "semantic"]
    assert rows["X-3-semg", "a.json"]["severity"] == "high"
    assert [r[0] for r in rules.duplicate_ids(table).collect()] == ["X-1"]
    assert [r.check_id for r in rules.runnable(table)] == ["X-1", "X-2", "X-1"]
    assert rules.search(table, "x-2").count() == 1
    assert len(rules.version(spark, str(tmp_path))) == 12
    snap = rules.snapshot(table, str(tmp_path / "snap"), "v1")
    assert snap.count() == table.count()


def test_tree_source(spark, tmp_path):
    for rel, data in {"a/x.py": b"one", "a/node_modules/y.py": b"two", "b.py": b"[SCAN_EXCLUDE] x", "c.py": b"\x00bin", "d.txt": b"t", "e.py": "été".encode()}.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    got = corpus.read_tree(spark, str(tmp_path), extensions=[".py"])
    assert sorted(r["rel"] for r in got.collect()) == ["a/x.py", "e.py"]
    assert got.where("basename = 'e.py'").first()["content"] == "été"
    named = spark.createDataFrame([("z/app.py", "app.py"), ("a/b.py", "b.py")], "path string, basename string")
    assert corpus.first_files(named, 1).first()["basename"] == "app.py"


def test_manifests_and_diffs(spark):
    req = spark.createDataFrame([("r", "flask==2.0\n# no\n-r x\nrequests\nnumpy[all]>=1  # why\n\n")], "path string, content string")
    assert [(r["name"], r["pinned"]) for r in corpus.requirements(req).orderBy("line_no").collect()] == [("flask", True), ("requests", False), ("numpy", True)]
    pkg = spark.createDataFrame([("p", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("q", "broken")], "path string, content string")
    assert sorted(tuple(r)[1:] for r in corpus.package_dependencies(pkg).collect()) == [("dependencies", "a", "^1"), ("devDependencies", "b", "2")]
    proj = spark.createDataFrame([("p", '[project]\ndependencies = [\n "flask>=1",\n "six"\n]')], "path string, content string")
    assert sorted(r["name"] for r in corpus.project_dependencies(proj).collect()) == ["flask", "six"]
    status = spark.createDataFrame([("M\ta.py\nR100\told.py\tnew.py\r\nD\tz\n",)], "text string")
    assert sorted(tuple(r) for r in corpus.changed_files(status).collect()) == [("D", "z"), ("M", "a.py"), ("R", "new.py")]


def test_lines_by_every_boundary(spark):
    row = spark.createDataFrame([("a\r\nb\x0bc d\n",), ("",)], "t string").select(X.split_lines(F.col("t")))
    assert [r[0] for r in row.collect()] == ["a\r\nb\x0bc d\n".splitlines(), []]


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([("hoch", 2), ("中", 10)], "level string, n int")
    assert corpus.markdown_table(counts).splitlines()[0] == "| level | n |"
    assert corpus.ascii_table(counts).splitlines()[0] == "+-------+----+"
    assert "<td>2</td>" in corpus.html_report("t", counts)
    corpus.report_json(counts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert corpus.config_with_defaults('{"a": {"b": 1}}', {"a": {"b": 0, "c": 2}, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}
    md = spark.createDataFrame([("r_20240102_030405.md", "Score: 87\nIssues: 12\nFiles: 40")], "path string, content string")
    assert corpus.parsed_reports(md).select("score", "total_issues", "file_count").first()[:] == (87, 12, 40)
