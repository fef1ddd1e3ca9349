"""Patterns are only tried on texts that hold one of the words they need, and only once."""

from sieveworks import packs
from sieveworks.operators.scan import Rule, evaluate, needed_words


def test_needed_words():
    assert needed_words(r"\bpickle\.loads?\s*\(") == {"pickle.load"}
    assert needed_words(r"(?:TODO|FIXME)\b") == {"todo", "fixme"}
    assert needed_words(r"(?:<{7}|>{7}) ") == {"<<<<<<<", ">>>>>>>"}
    for pattern in (r"ab|\d", r"(?:ab)?c", r"(?:ab)*", r"[[ab]]cd", r"(?x)a b c d", r"\Qab\E", "é", r"(?!abc)", r"(", r"(?:ab|)"):
        assert needed_words(pattern) is None, pattern
    for r in packs.core():
        words = needed_words(r["pattern"])
        assert words is None or any(w in r["bad"].lower() for w in words), r["check_id"]


def test_letters_that_stand_for_ascii_when_case_is_ignored(spark):
    texts = ["secret", "SECRET", "ſecret", "maKe", "Make", "İnk", "ınk", "INK", "other", None, ""]
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path int, content string")
    hits = {(r["path"], r["rule_id"]) for r in evaluate(files, [Rule("S", "secret"), Rule("M", "make"), Rule("I", "ink"), Rule("C", "INK", ignore_case=False)], basename=None).collect()}
    assert hits == {(0, "S"), (1, "S"), (2, "S"), (3, "M"), (4, "M"), (5, "I"), (6, "I"), (7, "I"), (7, "C")}


def test_patterns_are_matched_once(spark):
    files = spark.createDataFrame([("a", "x")], "path string, content string")
    plan = evaluate(files, [Rule("A", r"ab\d")], basename=None).groupBy("rule_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]
    assert "contains" in plan.lower()
