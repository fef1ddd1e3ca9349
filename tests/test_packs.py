"""Every rule of the pack breaks where it should and nowhere else, in one scan."""

from sieveworks import packs
from sieveworks.functions.text import glob_regex
from sieveworks.operators.scan import evaluate


def name_for(glob):
    return glob.split(",")[0].strip().replace("*", "x")


def test_examples(spark):
    rules = packs.core()
    assert len({r["check_id"] for r in rules}) == len(rules)
    rows = [(f"{r['check_id']}/{kind}", name_for(r["file_pattern"]), r[kind]) for r in rules for kind in ("bad", "ok")]
    files = spark.createDataFrame(rows, "path string, basename string, content string")
    hits = {(r["path"], r["rule_id"]) for r in evaluate(files, packs.rules()).collect()}
    for r in rules:
        import re

        assert re.match(glob_regex(r["file_pattern"]), name_for(r["file_pattern"]))
        assert (f"{r['check_id']}/bad", r["check_id"]) in hits, r["check_id"]
        assert (f"{r['check_id']}/ok", r["check_id"]) not in hits, r["check_id"]
