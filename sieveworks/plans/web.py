"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveworks.functions.text import contrast
from sieveworks.plans.base import query, table

#: What pages are counted by; both engines read these patterns alike.
COUNTS = {"links": "(?i)<a[ >]", "headings": "(?i)<h[1-6][ >]", "scripts": "(?i)<script[ >]", "inline_scripts": "(?i)<script>[^<]", "comments": "<!--", "images": "(?i)<img[ >]", "forms": "(?i)<form[ >]", "semantic": "(?i)<(article|nav|footer|header|main|section|aside)[ >]", "inline_styles": "(?i) style=", "paragraphs": "(?i)<p[ >]"}


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}'))::BIGINT AS {k}" for k, p in COUNTS.items()) + " FROM pages")
def html_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", *(F.regexp_count("html", F.lit(p)).cast("long").alias(k) for k, p in COUNTS.items()))


@query("SELECT lang, count(*) AS pages FROM (SELECT regexp_extract(html, '<html[^>]* lang=\"([a-z-]+)\"', 1) AS lang FROM pages) GROUP BY lang")
def html_lang(spark, sf):
    return table(spark, sf, "pages").select(F.regexp_extract("html", '<html[^>]* lang="([a-z-]+)"', 1).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars, min(page_id) AS first FROM pages GROUP BY 1")
def host_profile(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"), F.min("page_id").alias("first"))


@query("SELECT page_id, CASE WHEN length(title) = 0 THEN 'missing' WHEN length(title) > 50 THEN 'long' ELSE 'good' END AS verdict FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def title_check(spark, sf):
    t = F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf, "pages").select("page_id", F.when(t == 0, "missing").when(t > 50, "long").otherwise("good").alias("verdict"))


@query("SELECT * FROM (VALUES ('a', 1), ('b', 1), ('b', 2)) t(path, missing)")
def image_and_label_checks(spark, sf):
    """Images without a text (1) and inputs without a label (2) in small pages, which the table's pages have none of."""
    rows = [("a", '<img src="x"><img src="y" alt="why"><input id="q"><label for="q">Q</label>'), ("b", '<img src=z><input id="w"><label for="q">')]
    pages = spark.createDataFrame(rows, "path string, html string")
    images = F.filter(F.regexp_extract_all("html", F.lit(r"(<img\b[^>]*>)"), F.lit(1)), lambda t: ~t.rlike(r"\balt\s*="))
    inputs = F.regexp_extract_all("html", F.lit(r"<input\b[^>]*\bid=[\"']?([\w-]+)"), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(r"<label\b[^>]*\bfor=[\"']?([\w-]+)"), F.lit(1))
    found = F.array(F.when(F.size(images) > 0, 1), F.when(F.size(F.array_except(inputs, labels)) > 0, 2))
    return pages.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("missing"))


@query("SELECT name, ratio::DOUBLE AS ratio, readable FROM (VALUES ('black on white', 21.0, true), ('grey on white', 4.48, false), ('white on white', 1.0, false)) t(name, ratio, readable)")
def colour_contrast(spark, sf):
    rows = [("black on white", 0, 0, 0, 255, 255, 255), ("grey on white", 119, 119, 119, 255, 255, 255), ("white on white", 255, 255, 255, 255, 255, 255)]
    c = spark.createDataFrame(rows, "name string, a int, b int, c int, d int, e int, f int")
    ratio = contrast(*(F.col(x) for x in "abcdef"))
    return c.select("name", F.round(ratio, 2).alias("ratio"), (ratio >= 4.5).alias("readable"))
