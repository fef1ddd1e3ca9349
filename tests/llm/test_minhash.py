import collections
import math
import random

import numpy as np
import pyarrow as pa

from sieveworks.llm import graph, kernels, minhash

WORDS = [f"w{i}" for i in range(500)]


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])


def similarity(a, b):
    wa, wb = ({k: 1 + math.log(n) for k, n in c.items()} for c in (a, b))
    return sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in {*wa} & {*wb})


def groups(rows):
    label = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and similarity(x, y) >= 0.8 - 1e-9]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=0):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(40, 200))) for _ in range(25)]
    texts = list(base)
    for k in range(60):
        texts.append(edited(rng, base[k % 10], rng.randrange(0, 6)))
    hot = " ".join(rng.choices(WORDS, k=120))
    texts += [edited(rng, hot, rng.randrange(0, 9)) for _ in range(60)] + [hot.upper()] * 6
    texts += ["one two", "one two", "a b c d e", "same same same same same same same", "line one here now\n" * 30, "line one here now\n" * 31]
    rng.shuffle(texts)
    return texts


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, key string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == groups(rows)


def test_further_pivots_give_the_same(spark):
    rows = list(enumerate(corpus(1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, pairs_per_node=1).collect()}
    assert few == groups(rows)


def test_signatures_estimate_the_similarity():
    rng = random.Random(4)
    text = " ".join(rng.choices(WORDS, k=300))
    for edits in (2, 10, 25):
        pair = [text, edited(rng, text, edits)]
        ids, w, own, _, _ = minhash.weighted_shingles(pa.array(pair))
        sig = minhash.signatures(ids, w, own, 2)
        want = similarity(*map(shingles, pair))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.12
        m = own == 0
        assert abs(minhash.probability_jaccard(ids[m], w[m].astype(np.float32), ids[~m], w[~m].astype(np.float32)) - want) < 1e-5


def test_weights_in_the_exact_similarity():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ({int(k): int(n) for k, n in zip(rng.integers(0, 12, 8), rng.integers(1, 9, 8), strict=True)} for _ in range(2))
        arrays = [x for c in (a, b) for x in (np.array(sorted(c), np.uint32), np.array([1 + math.log(c[k]) for k in sorted(c)], np.float32))]
        assert abs(minhash.probability_jaccard(*arrays) - similarity(collections.Counter(a), collections.Counter(b))) < 1e-5


def test_one_of_each_group_stays(spark, docs):
    long = " ".join(WORDS[:60])
    texts = [long, long, None, "", "other words stand in this one text", long.upper(), "", long]
    table = docs(texts, ids=[5, 3, 8, 9, 10, None, 9, 3])
    kept = minhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "3", "8", "9", "None"]
    assert minhash.keep_one(docs([])).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["Alpha beta, gamma_1! été", None, "", "x" * 5000 + " y", "a b c d e f " * 40, "end"])
    want = kernels.word_hashes(texts, spans=True)
    monkeypatch.setattr(kernels, "SLICE", 64)
    kernels._powers.clear()
    got = kernels.word_hashes(texts, spans=True)
    kernels._powers.clear()
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert len(np.unique(kernels.word_hashes(pa.array(["ab ba a b aab aba baa"]))[0])) == 7


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(300, k) for k in range(301, 340)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent if any(a != b and x in (a, b) for a, b in edges)}


def test_of_repeated_ids_the_smallest_text_stays(spark, docs):
    texts = ["b text of six words in all", "a text of six words in all", None, "other words that are by themselves here", "other words that are by themselves here"]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0]):
        table = docs([texts[i] for i in order], ids=[1 if i < 3 else 2 for i in order]).repartition(3)
        got = {r["doc_id"]: r["text"] for r in minhash.keep_one(table).collect()}
        assert got == {1: texts[1], 2: texts[3]}


def test_looked_up(spark, monkeypatch):
    """Frequent keys, missing ones and nulls find what a plain left join finds."""
    from sieveworks.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 20}", "x") for i in range(120)]
    left = spark.createDataFrame(rows, "n long, key string, _hot string").withColumnRenamed("_hot", "more")
    right = spark.createDataFrame([("hot", 1, None), ("k2", 2, "b"), ("k5", 3, "c"), ("no", 4, "d")], "key string, v long, w string")
    want = sorted(left.join(right, "key", "left").select("n", "key", "more", "v", "w").collect(), key=lambda r: r["n"])
    assert sorted(common.looked_up(left, right, "key").collect(), key=lambda r: r["n"]) == want
    assert sorted(common.looked_up(left, right, "key", right.select("key").limit(0)).collect(), key=lambda r: r["n"]) == want
