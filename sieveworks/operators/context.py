"""What the surroundings of a line tell: test data, the scene of a query or a file, lines that only look sensitive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.schema import lookup

# Words of test data, and patterns of values that stand in for real ones.
MOCK_WORDS = ["mock", "test", "demo", "example", "placeholder", "dummy", "fake", "sample", "stub", "fixture", "is_mock", "is_test", "is_demo", "testing", "mock_key", "test_key", "mock_api", "test_api", "fake_data", "sample_data", "default_value"]
MOCK_VALUES = ["mock[-_]?key", "test[-_]?key", "demo[-_]?key", "mock[-_]?secret", "test[-_]?secret", "mock[-_]?password", "test[-_]?password", "example[-_]?key", "placeholder", "xxx+", r"\*\*\*+", "your[-_]?here", "changeme", "changethis", "replace_me", "123456", "password123", "localhost", r"127\.0\.0\.1"]
# Words of a value that stands in for a real one.
STAND_INS = ["mock", "test", "demo", "example", "placeholder", "dummy", "fake", "sample", "changeme"]
# Words in names of variables that come from users, and that name parts of a query.
USER_WORDS = ["request", "user_input", "input_data", "form_data", "json_data", "post_data", "body", "payload", "user_id", "username", "email", "name", "query_params", "params", "args"]
PART_WORDS = ["updates", "columns", "fields", "table_name", "col", "column", "field", "set_clause", "order_by", "sort_by", "group_by", "select_fields", "update_fields"]
# Engines by the first part of a rule id; others are the first engine's.
ENGINE_OF_PREFIX = {"SEC": "2", "B2": "2", "B3": "3", "B4": "4", "B5": "5", "B6": "6", "B7": "7", "PERF": "4", "DEP": "5", "ARCH": "7"}


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _like(text: Column, patterns: list[str], whole: bool = False) -> Column:
    joined = "|".join(patterns)
    return text.rlike(f"^(?:{joined})$" if whole else joined)


def mock_context(line: Column, context: Column) -> Column:
    """Whether a line with those around it is test data: two words of it, one and a stand-in value, or a test's definition."""
    text = F.lower(F.concat_ws("\n", line, context))
    words = sum((text.contains(w).cast("int") for w in MOCK_WORDS), F.lit(0))
    return (words >= 2) | (words >= 1) & _like(F.lower(line), MOCK_VALUES) | text.rlike(r"(def|class)\s+\w*(mock|test|demo|fake)\w*")


def mock_value(value: Column) -> Column:
    """Whether a value is too short to be real or stands in for a real one; empty ones are neither."""
    v = F.regexp_replace(F.lower(value), "^[\"' ]+|[\"' ]+$", "")
    size = F.length(v)
    return F.when(size == 0, False).otherwise((size < 8) | _like(v, MOCK_VALUES, True) | _has(v, STAND_INS) & (size < 30) | v.rlike(r"^[x*]+$"))


def basename(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def is_test_file(path: Column) -> Column:
    return basename(path).startswith("test_") | basename(path).endswith("_test.py")


def safe_sensitive_line(line: Column, context: Column, path: Column) -> Column:
    """Why a line that looks sensitive is not: mock, environment, placeholder, test file, config default, comment; else null."""
    value = F.regexp_extract(line, "[\"']([^\"']{6,})[\"']", 1)
    reads = _has(context, ["os.environ", "getenv"])
    return (
        F.when(mock_context(line, context), "mock")
        .when(_has(line, ["os.environ", "os.getenv"]), "environment")
        .when((value != "") & mock_value(value), "placeholder")
        .when(is_test_file(path) | F.lower(F.translate(path, "\\", "/")).contains("/tests/"), "test file")
        .when(basename(path).isin("config.py", "settings.py") & reads & (value != "") & (mock_value(value) | (F.length(value) < 16)), "config default")
        .when(F.trim(line).rlike(r"^(#|//|/\*)"), "comment")
    )


def sql_scene(line: Column, context: Column) -> Column:
    """struct(parameterized, parts, users, structural): whether a query takes parameters, how many of its embedded variables
    name parts of a query and how many come from users, and whether it is put together from parts only."""
    text = F.concat_ws("\n", line, context)
    takes = text.rlike(r"(?i)\.execute\s*\([^)]*,\s*(?:params|[(\[{])|cursor\.execute\s*\([^)]*,\s*")
    found = F.transform(F.regexp_extract_all(line, F.lit(r"\{([^{}]+)\}"), F.lit(1)), lambda v: F.lower(F.trim(v)))
    parts = F.size(F.filter(found, lambda v: _has(v, PART_WORDS)))
    users = F.size(F.filter(found, lambda v: ~_has(v, PART_WORDS) & _has(v, USER_WORDS)))
    joined = line.rlike(r"(?i)join\s*\(\s*(?:updates|columns|fields)")
    structural = F.when(F.size(found) == 0, joined).otherwise(takes & ((parts > 0) | (users == 0)))
    return F.struct(takes.alias("parameterized"), parts.alias("parts"), users.alias("users"), structural.alias("structural"))


def file_scene(path: Column) -> Column:
    """What a file's name says it is for; unknown if nothing."""
    name = basename(path)
    return F.when(is_test_file(path), "mock_test_config").when(name.rlike("^(patch_|migrate_|fix_|deploy_|setup_)"), "ops_patch_script").when(name.contains("email") & name.contains("sender"), "email_attachment").when(name.isin("config.py", "settings.py", "constants.py"), "init_config").otherwise("unknown")


def function_scene(content: Column) -> Column:
    """What a function is for, by its text."""
    text = F.lower(content)
    return F.when(text.rlike(r"def\s+(test_|mock_|demo_|fake_|fixture)"), "mock_test_config").when(text.rlike(r"@app\.|@router\.|@.*route|@.*get|@.*post"), "http_handler").when(_has(text, ["smtplib", "email.mime", "邮件"]), "email_attachment").otherwise("unknown")


def needs_verification(kind: Column, value: Column, context: Column, parameterized: Column, users: Column, scene: Column) -> Column:
    """Whether a person has to look at a finding before it counts: it may be harmless, but the lines do not tell."""
    unsure = F.length(value) < 20
    return F.coalesce(F.when(kind == "sensitive_info", unsure | _has(F.lower(context), ["example", "sample", "demo"])).when(kind == "sql_injection", parameterized & (users == 0)).when(kind == "file_upload", scene == "unknown"), F.lit(False))


def engine_id(check_id: Column, source_dir: Column, by_dir: dict[str, str] | None = None) -> Column:
    """The engine of a rule: by its folder, else by the first part of its id, else the first engine."""
    own = lookup(by_dir, source_dir) if by_dir else F.lit(None).cast("string")
    return F.coalesce(own, lookup(ENGINE_OF_PREFIX, F.upper(F.substring_index(check_id, "-", 1))), F.lit("1"))
