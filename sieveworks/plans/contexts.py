"""Queries about the surroundings of lines, over lines and files made of the columns of parts: both engines read the same
expressions, and the SQL finds the results from the texts by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks import packs
from sieveworks.operators import context as K
from sieveworks.operators import scan as S
from sieveworks.plans.base import query, table


def pick(column: str, values: list[str]) -> str:
    """SQL that both engines read: one of the values by a column's remainder."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_NAME = pick("p_partkey", ["'api_key'", "'test_secret'", "'mock_token'", "'password'", "'# secret'", "'x = os.environ'"])
_VALUE = pick("p_size", ["'changeme'", "p_name", "'xxxxxxxxxx'", "'your_here'", "'example value of it'", "'localhost'", "'abcdef'", "'Zq81hfKw02mmXy77'", "p_type"])
_AROUND = pick("p_partkey", ["'def test_it():'", "'a sample of a demo'", "'plain'", "'os.getenv()'", "p_brand"])
_PATH = pick("p_partkey", ["'src/test_a.py'", "'src/config.py'", "'migrate_x.py'", "'src/tests/b.py'", "'email_sender.py'", "'app/main.py'", "'a/settings.py'"])
_LINES = f"(SELECT p_partkey, ({_NAME}) || ' = \"' || ({_VALUE}) || '\"' AS line, ({_AROUND}) AS around, ({_PATH}) AS path FROM part)"
_VALUES = "|".join(K.MOCK_VALUES)
_COUNT = " + ".join(f"contains(t, '{w}')::INT" for w in K.MOCK_WORDS)


def _lines(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(f"({_NAME}) || ' = \"' || ({_VALUE}) || '\"'").alias("line"), F.expr(_AROUND).alias("around"), F.expr(_PATH).alias("path"))


@query(
    f"""WITH a AS (SELECT *, lower(line || chr(10) || around) AS t, regexp_extract(line, '["'']([^"'']{{6,}})["'']', 1) AS v, lower(string_split(path, '/')[-1]) AS b FROM {_LINES}),
m AS (SELECT *, ({_COUNT}) >= 2 OR (({_COUNT}) >= 1 AND regexp_matches(lower(line), '{_VALUES}')) OR regexp_matches(t, '(def|class)\\s+\\w*(mock|test|demo|fake)\\w*') AS mock,
  v <> '' AND (length(v) < 8 OR regexp_full_match(lower(v), '{_VALUES}') OR ({_any('lower(v)', K.STAND_INS)} AND length(v) < 30) OR regexp_full_match(lower(v), '[x*]+')) AS fake FROM a)
SELECT p_partkey, mock, CASE WHEN mock THEN 'mock' WHEN contains(line, 'os.environ') THEN 'environment' WHEN fake THEN 'placeholder' WHEN b LIKE 'test\\_%' ESCAPE '\\' OR contains(path, '/tests/') THEN 'test file'
  WHEN b IN ('config.py', 'settings.py') AND contains(around, 'getenv') AND v <> '' AND length(v) < 16 THEN 'config default' WHEN line LIKE '#%' THEN 'comment' END AS reason,
  CASE WHEN b LIKE 'test\\_%' ESCAPE '\\' THEN 'mock_test_config' WHEN b LIKE 'migrate\\_%' ESCAPE '\\' THEN 'ops_patch_script' WHEN b = 'email_sender.py' THEN 'email_attachment' WHEN b IN ('config.py', 'settings.py') THEN 'init_config' ELSE 'unknown' END AS scene FROM m"""
)
def safe_sensitive_lines(spark, sf):
    line, around, path = F.col("line"), F.col("around"), F.col("path")
    return _lines(spark, sf).select("p_partkey", K.mock_context(line, around).alias("mock"), K.safe_sensitive_line(line, around, path).alias("reason"), K.file_scene(path).alias("scene"))


_VAR = pick("p_partkey", ["'columns'", "'user_id'", "'x'", "'order_by'", "'request.body'"])
_REST = pick("p_size", ["', params)'", "')'", "', (a, b))'", "' + ids)'"])
_SQL_LINE = f"'cursor.execute(f\"select {{' || ({_VAR}) || '}} from ' || p_brand || '\"' || ({_REST})"
_PART = "regexp_matches(v, '" + "|".join(K.PART_WORDS) + "')"
_USER = "regexp_matches(v, '" + "|".join(K.USER_WORDS) + "')"


@query(
    f"""SELECT p_partkey, takes AS parameterized, {_PART}::INT AS parts, (NOT {_PART} AND {_USER})::INT AS users, takes AND ({_PART} OR NOT {_USER}) AS structural, takes AND NOT (NOT {_PART} AND {_USER}) AS unsure
FROM (SELECT p_partkey, ({_VAR}) AS v, p_size % 4 IN (0, 2) AS takes FROM part)"""
)
def sql_scenes(spark, sf):
    scene = table(spark, sf, "part").select("p_partkey", K.sql_scene(F.expr(_SQL_LINE.replace("{{", "{").replace("}}", "}")), F.lit("")).alias("s"))
    unsure = K.needs_verification(F.lit("sql_injection"), F.lit(""), F.lit(""), F.col("s.parameterized"), F.col("s.users"), F.lit(""))
    return scene.select("p_partkey", "s.*", unsure.alias("unsure"))


_ID = pick("p_partkey", ["'SEC-1'", "'perf-2'", "'B3-SEC'", "'ARCH-9'", "'NAME-001'", "'dep-X'"])


@query(f"SELECT p_partkey, CASE upper(string_split(({_ID}), '-')[1]) WHEN 'SEC' THEN '2' WHEN 'PERF' THEN '4' WHEN 'B3' THEN '3' WHEN 'ARCH' THEN '7' WHEN 'DEP' THEN '5' ELSE '1' END AS engine FROM part")
def engine_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.engine_id(F.expr(_ID), F.lit("")).alias("engine"))


@query()
def rule_catalog(spark, sf):
    """All rules of the pack over the whole texts of all documents, as files of any name, in one pass: hits and files by rule."""
    rules = packs.rules()
    found = S.evaluate(table(spark, sf, "documents"), rules, path="doc_id", basename=None, content="text")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))
