"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from sieveworks.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if value != value else f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted(tuple(canonical(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(canonical(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_rule_catalog_equals_plain_matching(spark):
    """The pack over all documents against each pattern by itself, without Spark."""
    import regex

    from sieveworks import packs

    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    want = {}
    for r in packs.rules():
        if r.words:
            hits = [int(not any(w.lower() in t.lower() for w in r.words)) for t in texts]
        else:
            found = regex.compile(r.pattern, regex.M | (regex.I if r.ignore_case else 0))
            hits = [sum(m.end() > m.start() for m in found.finditer(t)) for t in texts]
        if any(hits):
            want[r.check_id] = (sum(hits), sum(h > 0 for h in hits))
    assert {r["rule_id"]: (r["hits"], r["files"]) for r in catalog.QUERIES["rule_catalog"](spark, SF).collect()} == want
