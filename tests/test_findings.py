"""Laws that hold whatever the findings are."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.operators import findings as N
from sieveworks.operators import incremental as I
from sieveworks.operators import score as P

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
ROW = st.tuples(st.sampled_from("ab"), st.integers(1, 12), st.sampled_from(["R1", "R2", "R3"]), st.sampled_from(["ai", "rule", "semgrep", "x"]), st.sampled_from(["blocker", "high", "low", "odd"]), st.sampled_from(["high", "low", ""]))
SCHEMA = "file string, line int, rule_id string, engine string, severity string, confidence string, ord int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


@SLOW
@given(st.lists(ROW, max_size=25))
def test_exact_dedup_is_stable_and_idempotent(spark, rows):
    df = frame(spark, rows)
    kept = N.exact_dedup(df).where("kept").drop("kept")
    ids = sorted(r["ord"] for r in kept.collect())
    assert sorted(r["ord"] for r in N.exact_dedup(kept).where("kept").collect()) == ids
    assert sorted(r["ord"] for r in N.exact_dedup(df.orderBy(F.desc("ord"))).where("kept").collect()) == ids
    assert len(ids) == len({r[:3] for r in rows})


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 60)), max_size=25))
def test_clusters_are_gaps_apart(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, line int, ord int")
    got = N.clustered(df, ("file",), "line", 3).collect()
    for f in "ab":
        mine = sorted((r["line"], r["cluster"]) for r in got if r["file"] == f)
        for (a, x), (b, y) in zip(mine, mine[1:], strict=False):
            assert (x == y) == (b - a <= 3)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_equal_union_find(spark, edges):
    parent = list(range(13))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in N.components(df).collect()}
    assert got == {x: root(x) for e in edges for x in e}


@SLOW
@given(st.lists(st.lists(st.sampled_from(["b", "e", "be", ""]), max_size=8), min_size=1, max_size=4))
def test_clamped_depth(spark, files):
    rows = [(str(i), k + 1, s) for i, f in enumerate(files) for k, s in enumerate(f)]
    df = spark.createDataFrame(rows, "path string, line_no int, s string")
    got = {(r["path"], r["line_no"]): r["depth"] for r in N.depths(df, F.col("s").contains("b"), F.col("s").contains("e")).collect()}
    for i, f in enumerate(files):
        depth = 0
        for k, s in enumerate(f):
            depth += "b" in s
            depth = max(0, depth - ("e" in s))
            assert got[str(i), k + 1] == depth


def test_more_findings_never_raise_a_score(spark):
    one = [("SEC-1", "security", "error"), ("9.1", "", "warning"), ("14.2", "", "suggestion")]
    df = spark.createDataFrame([("p", *r) for r in one], "p string, rule_id string, category string, level string")
    first = P.weighted(df, "p").first()
    assert (first["bug"], first["code_smell"], first["engineering_maturity"], first["total"]) == (60, 95, 100, 74)
    again = P.weighted(df.union(df), "p").first()
    assert again["total"] <= first["total"] and again["total"] >= 0


def test_consensus_stays_between_a_share_and_one(spark):
    rows = [("f", 1, "R1", "rule", "high", "x", 0), ("f", 1, "R2", "ai", "low", "longer", 1), ("f", 1, "R3", "semgrep", "odd", "y", 2)]
    df = spark.createDataFrame(rows, "file string, line int, rule_id string, engine string, severity string, message string, ord int")
    r = N.consensus(df, ["file", "line"], F.lit(4)).first()
    assert (r["rule_id"], r["severity"], r["message"], r["detected_by"], r["consensus"], r["conflict"]) == ("R3", "high", "longer", ["ai", "rule", "semgrep"], 0.75, True)


def test_similar_pairs_equal_brute_force(spark):
    words = ["missing await here", "missing await there", "missing awaits here", "unused import os", "unused import sys", "x", "", "missing await here"]
    df = spark.createDataFrame([("f", i, w) for i, w in enumerate(words)], "file string, k int, t string")
    grams = [{w[i : i + 2] for i in range(len(w) - 1)} if len(w) > 1 else {w} for w in words]
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    assert {(r["a"], r["b"]) for r in N.similar_pairs(df, ["file"], "k", "t").collect()} == want


def test_similar_pairs_in_parts_with_rare_pairs(spark, monkeypatch):
    """Several parts, numbers of pairs that fill more than one part, copies, short texts, and pairs of characters without a bit."""
    import random

    from sieveworks.operators import alike

    monkeypatch.setattr(alike, "PART", 7)
    monkeypatch.setattr(alike, "COMMON", 20)
    monkeypatch.setattr(alike, "AT_ONCE", 16)
    rng = random.Random(3)
    texts = ["", "", "x", "x", "y", "\U0001f600", "ab"] + ["same text over and over"] * 12
    for k in range(40):
        base = "".join(rng.choice("abcdefgh ") if k % 2 else chr(rng.randrange(0x4E00, 0x4E80)) for _ in range(rng.randrange(20, 80)))
        texts += [base, base[: -rng.randrange(1, 9)], base[3:] + "zq"]
    rows = [(("f", None)[i == 9], i, t) for i, t in enumerate(texts)] + [("g", 500, texts[-1]), ("f", None, "x"), ("f", 501, None)]
    df = spark.createDataFrame(rows, "file string, k long, t string")
    grams = {k: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t} for f, k, t in rows if f == "f" and k is not None and t is not None}
    want = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in grams for j in grams if i < j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    got = alike.similar_pairs(df, ["file"], "k", "t").collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want) > 150


def test_links_of_many_copies_stay_in_proportion(spark):
    """Of 300 near copies, with 44,850 pairs, come fewer links than texts, and they connect all."""
    texts = [f"one long sentence that is alike in all of the many texts here {i % 10}" for i in range(300)] + ["another text"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, k long, t string")
    links = N.similar_links(df, ["file"], "k", "t")
    assert links.count() == 299
    assert {(r["node"], r["component"]) for r in N.components(links).collect()} == {(i, 0) for i in range(300)}


def test_eviction_keeps_the_latest(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(30)], "id int, at int")
    kept = {r["id"] for r in I.evict(df, "at", "id", 20).where("kept").collect()}
    assert len(kept) == 18 and min(i // 3 for i in kept) == 4
    assert I.evict(df, "at", "id", 30).where("kept").count() == 30


def test_whole_texts_are_compared(spark, tmp_path):
    """Other languages, further lines and what stands past character 40 count."""
    from sieveworks.plans import catalog

    same, own = "the first line is the same in all of the texts here", "0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ !$%&/()=?"
    texts = [same, f"{same}\n{own}", f"{same}\n{own}.", "ein anderer Text\nmit Zeilen", "ein anderer Text\nmit Zeilen!", "x", "", None]
    rows = [(i, t, "de" if t and "Zeilen" in t else "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = [None if t is None else {t[i : i + 2] for i in range(len(t) - 1)} or {t} for t in texts]
    want = {(i, j) for i, p in enumerate(grams) for j, q in enumerate(grams) if i < j and p and q and len(p & q) >= 0.8 * len(p | q)}
    assert want == {(1, 2), (3, 4)}
    assert {(r["a"], r["b"]) for r in catalog.QUERIES["jaccard_ngram_pairs"](spark, str(tmp_path)).collect()} == want
    assert {(r["node"], r["component"]) for r in catalog.QUERIES["similarity_components"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_long_chains_are_followed_to_their_end(spark):
    from sieveworks.operators.findings import components
    from sieveworks.operators.graph import reachable

    chain = spark.range(70).selectExpr("id as src", "id + 1 as dst")
    starts = spark.createDataFrame([(0,)], "node long")
    assert max(r["hops"] for r in reachable(chain, starts).collect()) == 70
    assert {r["component"] for r in components(chain, "src", "dst").collect()} == {0}
