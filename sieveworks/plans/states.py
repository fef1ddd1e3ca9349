"""Queries over state and history: incremental runs, caches, trends, engines, knowledge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveworks.operators import history as H
from sieveworks.operators import incremental as I
from sieveworks.plans.base import query, table
from sieveworks.streaming import state as Z


_FROM, _TO = "1996-01-01", "2000-07-01"


def _sides(spark, sf):
    """The orders since _FROM as the files of now, those up to _TO as the files of the last run; in between, urgent ones had
    another size, low ones another hash, and those still open another time."""
    o = table(spark, sf, "orders")
    o = o.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("hash"), F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("mtime"))
    old = o.where(F.col("mtime") < F.lit(_TO).cast("date"))
    old = old.withColumn("size", F.when(F.col("p") == "1-URGENT", F.col("size") + 1).otherwise(F.col("size"))).withColumn("mtime", F.when(F.col("hash") == "O", F.date_add("mtime", -1)).otherwise(F.col("mtime"))).withColumn("hash", F.when(F.col("p") == "5-LOW", F.lit("?")).otherwise(F.col("hash")))
    return o.where(F.col("mtime") >= F.lit(_FROM).cast("date")).drop("p"), old.drop("p")


_STATUS = f"CASE WHEN o_orderdate >= DATE '{_TO}' THEN 'added' WHEN o_orderdate < DATE '{_FROM}' THEN 'deleted' ELSE"
_DIFF = f"(SELECT o_orderkey AS path, {_STATUS} CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'changed' ELSE 'unchanged' END END AS status FROM orders)"


@query(f"SELECT * FROM {_DIFF}")
def incremental_diff(spark, sf):
    return I.diff(*_sides(spark, sf), "path", ["size", "hash"])


@query(f"SELECT o_orderkey AS path, {_STATUS} CASE WHEN o_orderstatus <> 'O' THEN 'unchanged' WHEN o_orderpriority = '5-LOW' THEN 'changed' ELSE 'touched' END END AS status FROM orders")
def incremental_two_step(spark, sf):
    return I.diff_two_step(*_sides(spark, sf), "path")


@query(f"SELECT path, l_linenumber::BIGINT AS line, origin FROM (SELECT path, status, l_linenumber, CASE WHEN status IN ('added', 'changed') THEN 'fresh' ELSE 'cached' END AS origin FROM {_DIFF} JOIN lineitem ON l_orderkey = path WHERE status <> 'deleted')")
def cache_merge(spark, sf):
    status = I.diff(*_sides(spark, sf), "path", ["size", "hash"])
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"))
    status = I.dealt(status, "path", rows)
    fresh = rows.join(status.where("status in ('added', 'changed')"), "path", "left_semi").withColumn("origin", F.lit("fresh"))
    return I.merge_cached(fresh, rows.withColumn("origin", F.lit("cached")), status, "path")


@query("SELECT event_id, (SELECT count(*) FROM events) <= 1000 OR row_number() OVER (ORDER BY ts DESC, event_id) <= 900 AS kept FROM events")
def lru_evict(spark, sf):
    return I.evict(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 1000).select("event_id", "kept")


@query("SELECT user_id, n, sum(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING) <= 5000 AS kept FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def cache_cap(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return I.budget(per, [F.desc("n"), F.col("user_id")], "n", 5000)


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS expired FROM events")
def ttl_expire(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return I.expired(e.crossJoin(F.broadcast(now)), "ts", F.col("now"), 7).select("event_id", "expired")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)")
def checkpoint_remaining(spark, sf):
    e = table(spark, sf, "events")
    return I.remaining(e, e.where("event_type = 'purchase' and value > 60"), "user_id")


@query("SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS done, round(sum(value), 4) AS cost FROM events GROUP BY user_id")
def checkpoint_summary(spark, sf):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), n("error").alias("failed"), n("purchase").alias("done"), F.round(F.sum("value"), 4).alias("cost"))


_DIFFS = [("a.py", "--- a/a.py\n+++ b/a.py\n@@ -1,3 +1,4 @@\n one\n+two\n three\n-four\n+five\n@@ -10 +11,2 @@ def f():\n+six\n seven"), ("b.js", "@@ -0,0 +1,2 @@\n+x\n+y\n\\ No newline at end of file")]


@query("SELECT * FROM (VALUES ('a.py', 2, 'two'), ('a.py', 4, 'five'), ('a.py', 11, 'six'), ('b.js', 1, 'x'), ('b.js', 2, 'y')) t(path, new_line, line)")
def diff_hunk_lines(spark, sf):
    return I.hunk_lines(spark.createDataFrame(_DIFFS, "path string, diff string"))


_DAYS = "(SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS issues, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"


@query(f"SELECT day, issues, errors, (issues - lag(issues) OVER (ORDER BY day))::BIGINT AS issues_change, (errors - lag(errors) OVER (ORDER BY day))::BIGINT AS errors_change FROM {_DAYS}")
def trend_daily(spark, sf):
    return H.trend(_days(spark, sf), [], "day", "issues", "errors")


def _days(spark, sf, *keys):
    return table(spark, sf, "events").groupBy(*keys, F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("issues"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))


@query("SELECT event_type, arg_min(issues, day) AS first, arg_max(issues, day) AS last, arg_max(issues, day) - arg_min(issues, day) AS change, CASE WHEN arg_max(issues, day) < arg_min(issues, day) THEN 'improving' WHEN arg_max(issues, day) > arg_min(issues, day) THEN 'degrading' ELSE 'stable' END AS direction FROM (SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS issues FROM events GROUP BY 1, 2) GROUP BY event_type")
def improving_categories(spark, sf):
    return H.first_to_last(_days(spark, sf, "event_type"), ["event_type"], "day", "issues")


@query("SELECT user_id, count(*) AS n, round(avg(value) FILTER (value > 0), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 30 GROUP BY user_id")
def quality_ring30(spark, sf):
    ring = H.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", 30)
    return ring.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("mean"))


_RUNS = "(SELECT event_type, (user_id % 10) / 10.0 AS accuracy, (event_id % 240)::DOUBLE AS elapsed, (user_id % 5) / 10.0 AS fp_rate, (event_id % 7) / 100.0 AS cost FROM events)"


@query(
    f"""SELECT event_type, n AS samples, round(eff, 6) AS effectiveness, round(eff * greatest(0, 1 - t / 180), 6) AS efficiency, round(1 - f, 6) AS reliability, round(CASE WHEN c > 0 THEN eff / (1 + c * 50) ELSE eff END, 6) AS cost_efficiency,
round(0.35 * eff + 0.25 * eff * greatest(0, 1 - t / 180) + 0.25 * (1 - f) + 0.15 * CASE WHEN c > 0 THEN eff / (1 + c * 50) ELSE eff END, 6) AS composite FROM (SELECT event_type, count(*) AS n, avg(accuracy) AS eff, avg(elapsed) AS t, avg(fp_rate) AS f, avg(cost) AS c FROM {_RUNS} GROUP BY event_type)"""
)
def engine_scores(spark, sf):
    runs = table(spark, sf, "events").select("event_type", ((F.col("user_id") % 10) / 10.0).alias("accuracy"), (F.col("event_id") % 240).cast("double").alias("elapsed"), ((F.col("user_id") % 5) / 10.0).alias("fp_rate"), ((F.col("event_id") % 7) / 100.0).alias("cost"))
    out = H.engine_scores(runs, "event_type")
    return out.select("event_type", "samples", *(F.round(c, 6).alias(c) for c in ("effectiveness", "efficiency", "reliability", "cost_efficiency", "composite")))


@query(
    """SELECT task_id, round(similarity, 6) AS similarity FROM (SELECT event_id AS task_id, (CASE WHEN event_type = 'error' THEN 3.0 ELSE 0 END + CASE WHEN user_id % 3 = 1 THEN 2.0 ELSE 0 END + 1.5 * least(event_id % 90 + 1, 40) / greatest(event_id % 90 + 1, 40)::DOUBLE
+ 1.5 * CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 1 / 3.0 END) / 8.0 AS similarity FROM events) WHERE similarity > 0.1 ORDER BY similarity DESC, task_id LIMIT 20"""
)
def task_similarity(spark, sf):
    """The 20 past tasks most like a given one."""
    e = table(spark, sf, "events")
    langs = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("py"))).when(F.col("event_id") % 4 == 1, F.array(F.lit("py"), F.lit("js"))).when(F.col("event_id") % 4 == 2, F.array(F.lit("go"))).otherwise(F.array(F.lit("py"), F.lit("go")))
    past = e.select(F.col("event_id").alias("task_id"), F.col("event_type").alias("task_type"), (F.col("user_id") % 3).cast("string").alias("complexity"), (F.col("event_id") % 90 + 1).alias("file_count"), langs.alias("languages"), F.lit("").alias("framework"))
    task = spark.createDataFrame([("error", "1", 40, ["py", "js"], "")], "task_type string, complexity string, file_count int, languages array<string>, framework string")
    return H.nearest(past, task).select("task_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20")
def task_knn(spark, sf):
    """The 20 feature vectors nearest to a given one."""
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    one = v.where("vec_id = 0").select(F.col("e").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    s = v.where("vec_id <> 0").crossJoin(F.broadcast(one)).withColumn("s", dot(F.col("e"), F.col("q")) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(F.col("q"), F.col("q"))))
    return s.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("similarity"))


_SEEN = "(SELECT event_type || '/' || (user_id % 10)::VARCHAR AS pattern_id, ts, user_id, event_id FROM events)"


@query(f"SELECT pattern_id, count(*) AS occurrence_count, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS projects FROM {_SEEN} GROUP BY pattern_id")
def kb_upsert(spark, sf):
    """Two batches of sightings, the second added to what the first left."""
    e = table(spark, sf, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("pattern_id"), F.col("ts").alias("seen_at"), F.col("user_id").alias("project"), F.col("event_id").cast("string").alias("example"), "value")
    first = H.upsert_patterns(None, e.where("value < 20").drop("value"))
    out = H.upsert_patterns(first, e.where("value >= 20").drop("value"))
    return out.select("pattern_id", "occurrence_count", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), F.array_join("projects", ",").alias("projects"))


@query(f"SELECT pattern_id, 'new_rule' AS kind, round(least(1.0, n / 400.0), 6) AS confidence FROM (SELECT pattern_id, count(*) AS n FROM {_SEEN} GROUP BY pattern_id) WHERE n >= 200")
def kb_suggest(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("pattern_id"), F.col("ts").alias("seen_at"), F.col("user_id").alias("project"), F.col("event_id").cast("string").alias("example"))
    return H.suggestions(H.upsert_patterns(None, e), 200).select("pattern_id", "kind", F.round("confidence", 6).alias("confidence"))


@query("""WITH j AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS jump FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), k AS (SELECT *, sum(jump) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM j)
SELECT user_id, event_type, min(ts)::VARCHAR AS start, count(*) AS n FROM k GROUP BY user_id, event_type, s""")
def session_islands(spark, sf):
    e = table(spark, sf, "events")
    return Z.sessions(e, ["user_id", "event_type"], "ts", "3 hours").select("user_id", "event_type", F.col("start").cast("string").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    """Counts in windows of six hours, as the stream of findings keeps them."""
    return Z.counts_per_window(table(spark, sf, "events"), "ts", "6 hours", "1 hour", "event_type").select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def conversation_roles(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


_INJECT = "(?i)(ignore (all|previous) instructions|system prompt|the only|en le|you are)"


@query(f"SELECT conv_id, turn, coalesce(lag(role) OVER w, 'start') AS before, len(regexp_extract_all(text, '{_INJECT}'))::BIGINT AS hits FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user' AND regexp_matches(text, '{_INJECT}')")
def prompt_injection_scan(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("role").over(w), F.lit("start")))
    return c.where((F.col("role") == "user") & F.col("text").rlike(_INJECT)).select("conv_id", "turn", "before", F.regexp_count("text", F.lit(_INJECT)).cast("long").alias("hits"))
