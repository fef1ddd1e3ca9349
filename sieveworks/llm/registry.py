"""The ten queries, each applying its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import capfilter, decontam, langid, minhash, mixing, pii, quality, token_rollup, warc, wrapper
from sieveworks.llm.common import new_path, table


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.links(table(spark, sf_dir, "embeddings"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after four batches: all are inserted, a quarter of them as half of their text; that quarter
    is revised to its whole text and another one deleted; what was deleted comes back; and the second batch comes again,
    which changes nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    part = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    is_old, goes = F.coalesce(part == 0, F.lit(False)), F.coalesce(part == 1, F.lit(False))
    as_op = lambda op, rows: rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark)
    rollup.commit("load", as_op("insert", docs.withColumn("text", F.when(is_old, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text")))))
    changes = as_op("revise", docs.where(is_old)).unionByName(as_op("delete", docs.where(goes)))
    rollup.commit("changes", changes)
    rollup.compact()
    rollup.commit("back", as_op("insert", docs.where(goes)))
    rollup.commit("changes", changes)
    return rollup.totals()


def op3_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written from all pages, read back and assembled."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    got = warc.resolved(warc.assemble(warc.read(spark, path, payloads=False)))
    page = lambda col: F.regexp_extract(col, r"^id: (-?[0-9]+)", 1)
    number = lambda col: F.when(page(col) != "", page(col).cast("long"))
    return got.select(number("metadata.fields").alias("page_id"), "payload_bytes", "payload_digest", F.col("main.type").alias("record_type"), F.when(F.col("main.type") == "revisit", number("r_fields")).alias("refers_to"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, slot, release time, deadline and position of every document."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it leaks."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the smallest id of its group of near copies, and whether it is kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_cap_filters, op2_token_rollup, op3_warc_assembly, op4_pii_anchors, op5_pu_quality, op6_pfair_mix, op7_wrapper_induction, op8_byte_gru, op9_decontamination, op10_prob_minhash)}

ORACLES: dict[str, str] = {}

ORACLES["op1_cap_filters"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p, good q WHERE p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links,
       least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN least ON least.a = v.vec_id
"""

ORACLES["op3_warc_assembly"] = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 1 + 5 * i, 5)::BIT::INT, 1), '' ORDER BY i)
          FROM (SELECT string_agg(right(('0x' || substr(h, 1 + k, 1))::INT::BIT::VARCHAR, 4), '' ORDER BY k) AS bits FROM range(40) r(k)), range(32) q(i)) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS h FROM pages)
)
"""

ORACLES["op6_pfair_mix"] = """
WITH RECURSIVE per AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
q AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, source, n, greatest(1, round(sqrt(n) / (SELECT sum(sqrt(n)) FROM per) * 1000))::BIGINT AS q FROM per),
arr AS (SELECT list(q ORDER BY i) AS qs, list(n ORDER BY i) AS ns, sum(q)::BIGINT AS p FROM q),
edf(t, done, pick) AS (
  SELECT 0::BIGINT, list_transform(qs, lambda x: 0::BIGINT), NULL::BIGINT FROM arr
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i - 1 = m THEN 1 ELSE 0 END), m
  FROM (SELECT t, done, list_min(list_transform(done, lambda d, i: CASE WHEN d < qs[i] AND (d * p) // qs[i] <= t THEN (((d + 1) * p + qs[i] - 1) // qs[i]) * len(qs) + i - 1 ELSE 9223372036854775807 END)) % len(qs) AS m
        FROM edf, arr WHERE t < p)),
slots AS (SELECT t - 1 AS slot, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j, list_transform(done, lambda d, i: d - CASE WHEN i - 1 = pick THEN 1 ELSE 0 END) AS mine FROM edf WHERE t > 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM documents),
placed AS (SELECT d.doc_id, d.source, r // 16 AS k, r % 16 AS rest, (r // 16) // q.q AS turn, q.q, s.slot, s.j, s.mine
  FROM ranked d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN slots s ON s.pick = q.i AND s.j = (r // 16) % q.q)
SELECT doc_id, source, k::BIGINT AS mix_block, (turn * p + slot)::BIGINT AS mix_slot, (turn * p + (j * p) // q)::BIGINT AS mix_release, (turn * p + ((j + 1) * p + q - 1) // q)::BIGINT AS mix_deadline,
       (list_sum(list_transform(ns, lambda n, i: least(n, 16 * (turn * qs[i] + mine[i])))) + rest)::BIGINT AS mix_position
FROM placed, arr
"""
