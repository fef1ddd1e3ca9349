"""WARC archives: writing, reading, and assembling transactions.

write() turns captures into request, response (or revisit) and metadata records, all strings built by built-in
functions, and writes them as compressed text whose line separator is the end of a record. read() parses archives by
their Content-Length fields. assemble() joins records that name each other in WARC-Concurrent-To and gives one nested
row per capture; a revisit finds its payload's length and digest at the response that it refers to.

Defined results: a null payload is empty; payloads are equal if their SHA-1 and length are; among equal ones that of the
largest id is a response and the others revisit it, from min_revisit bytes on; rows equal in id, address and payload are
one capture; a null id never wins against another, and captures with equal ids are told apart by address and payload;
line ends in an address are replaced by blanks; records without a partner give captures whose other fields are null; a
record that names another that names a third is of the third's capture, longer chains than that are not followed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import HOT_KEYS, LEAST_HOT, broadcastable, cut, looked_up

#: Captures in one file at most.
FILE_CAPTURES = 2048
#: Bytes of first captures of repeated payloads that may be broadcast.
BROADCAST_FIRSTS = 32_000_000
CRLF = "\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 form of a SHA-1, by built-in functions: 5 hex digits make 4 of base 32."""
    h = F.sha1(data)
    digits = F.concat(*(F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *(x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))), F.lit(">"))


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last line end; fields that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields), F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block, F.lit(CRLF))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """One row per page: id, url, payload, digest, size, the capture's record id, and that of the response it revisits."""
    rows = pages.select(F.col(id_col).alias("id"), F.translate(_text(F.col(url_col)), "\r\n", "  ").alias("url"), _text(F.col(payload_col)).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    urn = _urn(F.lit("capture"), _text(F.col("id")), F.md5("url"), F.col("digest"))
    # ids and digests only: payloads are not shuffled for this
    who = F.struct(F.col("id").alias("i"), F.md5("url").alias("u"))
    firsts = rows.groupBy("digest", "size").agg(F.max_by(who, who).alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_revisit))
    firsts = cut(firsts.select(F.concat_ws("/", "digest", "size").alias("copies"), F.col("w.i").alias("first_id"), _urn(F.lit("capture"), _text(F.col("w.i")), F.col("w.u"), F.col("digest")).alias("first_urn"), "n"), "firsts")
    rows = rows.withColumn("copies", F.concat_ws("/", "digest", "size"))
    if broadcastable(firsts, "first_urn", BROADCAST_FIRSTS):
        rows = rows.join(F.broadcast(firsts.drop("n")), "copies", "left")
    else:  # payloads move, but those of one page's many copies do not meet
        hot = firsts.where(F.col("n") > max(LEAST_HOT, rows.count() // HOT_KEYS)).select("copies")
        rows = looked_up(rows, firsts.drop("n"), "copies", hot)
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return rows.select("id", "url", "payload", "digest", "size", urn.alias("urn"), F.when(revisit, F.col("first_urn")).alias("refers"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", **columns) -> None:
    """Writes the records of all pages as compressed archives below path."""
    c = captures(pages, **columns)
    head = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size"), F.lit(CRLF * 2))
    is_revisit = F.col("refers").isNotNull()
    main = _record(F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), [("WARC-Record-ID", F.col("urn")), *head, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.col("refers")), ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    request = _record(F.lit("request"), [("WARC-Record-ID", _urn(F.lit("request"), F.col("urn"))), *head, ("WARC-Concurrent-To", F.col("urn")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    meta = _record(F.lit("metadata"), [("WARC-Record-ID", _urn(F.lit("metadata"), F.col("urn"))), *head, ("WARC-Concurrent-To", F.col("urn")), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("id: "), _text(F.col("id")), F.lit(CRLF)))
    whole = F.concat(request, F.lit(CRLF), main, F.lit(CRLF), meta)
    c.select(whole.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(path)


def records(data: bytes):
    """(header fields by lower-case name, block) of each record of an uncompressed archive; what no version line opens is skipped to the next one."""
    at, end = 0, len(data)
    while at < end:
        if not data.startswith(b"WARC/", at):
            at = data.find(b"WARC/", at)
            if at < 0:
                return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = int(fields.get("content-length") or 0)
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while data.startswith(b"\r\n", at):
            at += 2


RECORD = T.StructType([T.StructField(n, k) for n, k in (("record_id", T.StringType()), ("type", T.StringType()), ("concurrent_to", T.StringType()), ("refers_to", T.StringType()), ("uri", T.StringType()), ("date", T.StringType()), ("stated_digest", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()), ("fields", T.StringType()))])
_PAYLOAD = T.StructField("payload", T.BinaryType())


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path; a metadata record's block is in fields."""
    schema = T.StructType([*RECORD.fields, *[_PAYLOAD] * payloads])

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                data = blob.as_buffer().to_pybytes()
                rows = []
                for f, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = f.get("warc-type")
                    http = f.get("content-type", "").startswith("application/http")
                    body = block.partition(b"\r\n\r\n")[2] if http else block
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind in ("response", "resource") else None
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, digest, len(body), block.decode("utf-8", "replace") if kind == "metadata" else None, *[body] * payloads))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for c, n in zip(cols, schema.names, strict=True)], names=schema.names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, and the nested records request, main (response, resource or revisit) and metadata."""
    is_main = F.col("type").isin("response", "revisit", "resource")
    links = found.where("concurrent_to is not null").select("record_id", "concurrent_to", is_main.alias("m"))
    # whichever record names the other, the link leads to the response; a link between two others is followed once more
    edges = links.select(F.when(F.col("m"), F.col("concurrent_to")).otherwise(F.col("record_id")).alias("child"), F.when(F.col("m"), F.col("record_id")).otherwise(F.col("concurrent_to")).alias("parent"))
    edges = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    onward = edges.select(F.col("child").alias("parent"), F.col("parent").alias("root"))
    edges = edges.join(onward, "parent", "left").select("child", F.coalesce("root", "parent").alias("root"))
    keyed = found.join(edges.withColumnRenamed("child", "record_id"), "record_id", "left")
    keyed = keyed.withColumn("capture_id", F.when(is_main, F.col("record_id")).otherwise(F.coalesce("root", "record_id")))
    whole = F.struct(*found.columns)
    one = lambda cond, name: F.min_by(F.when(cond, whole), F.when(cond, F.col("record_id"))).alias(name)
    return keyed.groupBy("capture_id").agg(one(F.col("type") == "request", "request"), one(is_main, "main"), one(F.col("type") == "metadata", "metadata"))


def resolved(capture: DataFrame) -> DataFrame:
    """captures with refers (the metadata fields of the response that a revisit refers to), payload_bytes and payload_digest of the full payload."""
    # what revisits nothing has no key, and many revisits of one response do not meet
    known = cut(capture.withColumn("target", F.when(F.col("main.type") == "revisit", F.col("main.refers_to"))), "captures")
    targets = known.where("main.type <> 'revisit'").select(F.col("capture_id").alias("target"), F.col("metadata.fields").alias("r_fields"), F.col("main.payload_bytes").alias("r_bytes"), F.col("main.payload_digest").alias("r_digest"))
    joined = looked_up(known, targets, "target")
    revisit = F.col("main.type") == "revisit"
    return joined.select(*capture.columns, "r_fields", F.when(revisit, F.col("r_bytes")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("r_digest")).otherwise(F.col("main.payload_digest")).alias("payload_digest"))
