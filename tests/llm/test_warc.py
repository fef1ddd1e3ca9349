import base64
import hashlib

from pyspark.sql import functions as F

from sieveworks.llm import warc
from sieveworks.llm.common import new_path

HTML = ["<p>one</p>", "<p>two</p>", None, "", "<p>one</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n\r\n", "é" * 70_000, "<p>one</p>", "\r\n\r\nx"]


def test_round_trip(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(HTML)], "page_id long, url string, html string, digest string")
    path = new_path(spark, "t")
    warc.write(pages, path)
    found = warc.read(spark, path)
    assert found.count() == 3 * len(HTML)
    caps = warc.resolved(warc.assemble(found))
    assert caps.where("request is null or main is null or metadata is null").count() == 0
    got = {int(r["metadata"]["fields"].split()[1]): r for r in caps.collect()}
    for i, h in enumerate(HTML):
        data = (h or "").encode()
        last = max(k for k, x in enumerate(HTML) if (x or "") == (h or ""))
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert got[i]["main"]["type"] == ("response" if i == last else "revisit")
        assert bytes(got[i]["main"]["payload"]) == (data if i == last else b"")
        assert got[i]["main"]["stated_digest"] == got[i]["payload_digest"]
        if i != last:
            assert got[i]["r_fields"].split()[1] == str(last)
        assert got[i]["request"]["concurrent_to"] == got[i]["main"]["record_id"]


def test_repeats_nulls_and_nothing(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, None)]
    path = new_path(spark, "t")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    kinds = sorted((r["main"]["type"], r["metadata"]["fields"]) for r in warc.assemble(warc.read(spark, path)).collect())
    assert kinds == [("response", "id: \r\n"), ("response", "id: 1\r\n"), ("revisit", "id: \r\n")]
    path = new_path(spark, "t")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read(spark, path)).count() == 0


def test_links_in_either_direction(spark):
    schema = "record_id string, type string, concurrent_to string, refers_to string"
    rows = [("a", "request", None, None), ("b", "response", "a", None), ("c", "metadata", "a", None), ("d", "request", "e", None), ("e", "response", None, None), ("f", "metadata", "d", None), ("g", "request", "gone", None)]
    got = {r["capture_id"]: (r["request"] and r["request"]["record_id"], r["main"] and r["main"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"b": ("a", "b", "c"), "e": ("d", "e", "f"), "gone": ("g", None, None)}


def test_base32(spark):
    row = spark.createDataFrame([("abc",), ("",)], "s string").select("s", warc.base32_sha1(F.col("s")))
    assert all(r[1] == base64.b32encode(hashlib.sha1(r[0].encode()).digest()).decode() for r in row.collect())


def test_many_copies_without_a_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i}", "same" if i % 2 else "alike" if i % 3 else f"own {i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = ["id", "digest", "size", "urn", "refers", "payload"]
    want = sorted(map(tuple, warc.captures(pages).select(columns).collect()))
    monkeypatch.setattr(warc, "BROADCAST_FIRSTS", 0)
    assert sorted(map(tuple, warc.captures(pages).select(columns).collect())) == want
    assert sum(r[4] is not None for r in want) == 100 - 1 + 66 - 1
