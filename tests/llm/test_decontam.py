import random

import numpy as np

from sieveworks.llm import decontam as D

WORDS = [f"w{i}" for i in range(4000)]


def texts(rng, n, low, high):
    return [" ".join(rng.choices(WORDS, k=rng.randrange(low, high))) for _ in range(n)]


def matrix(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_equals_the_matrix():
    rng = random.Random(1)
    for _ in range(400):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 14))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 25))])
        score, start, end = D.align(a, b)
        assert score == matrix(a, b)
        assert score == 0 or matrix(a, b[start:end]) == score


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else ["new", w] if x < share * 2 / 3 else ["other"] if x < share else [w]
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = texts(rng, 30, 12, 50)
    docs = texts(rng, 60, 20, 200)
    for k in range(40):
        own, item = docs[k].split(), items[k % 30].split()
        at = rng.randrange(len(own))
        docs[k] = " ".join(own[:at] + edited(rng, item, [0, 0.1, 0.2, 0.6][k % 4]) + own[at:])
    docs += ["", None, items[0].upper() + "!", docs[0]]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, "too short", None, ""])], "item_id long, text string")
    want = set()
    for i, t in enumerate(docs):
        for j, item in enumerate(items):
            a, b = item.split(), (t or "").lower().replace("!", "").split()
            if set(a) & set(b) and matrix(a, b) >= D.threshold(len(a)):
                want.add((i, j, matrix(a, b)))
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in D.leaks(table, bench).collect()}
    run = D.N + D.STRIDE - 1  # what is promised: leaks that keep so many words in a row

    def keeps_a_run(i, j):
        a, b = items[j].split(), f" {docs[i].lower().replace('!', '')} "
        return any(f" {' '.join(a[k : k + run])} " in b for k in range(len(a) - run + 1))

    assert got <= want and {w for w in want if keeps_a_run(*w[:2])} <= got
    assert len(got) >= 0.95 * len(want) > 20
    kept = D.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(docs))) - {g[0] for g in got})


def test_regularly_edited_copies_are_found(spark):
    """An n-gram that an edit destroyed takes no other's place; words inserted in front of the first seed are aligned too."""
    rng = random.Random(4)
    items = texts(rng, 60, 15, 60)
    edits = [
        lambda ws: ["other" if k % 4 == 3 else w for k, w in enumerate(ws)],
        lambda ws: [x for k, w in enumerate(ws) for x in ([w, "new"] if k % 3 == 2 else [w])],
        lambda ws: [x for k, w in enumerate(ws) for x in ([w, "new"] if k % 2 and k < 20 else [w])],
    ]
    docs = [" ".join(["before"] * 90 + edit(item.split()) + ["after"] * 90) for edit in edits for item in items]
    scores = [matrix(items[k % 60].split(), t.split()) for k, t in enumerate(docs)]
    want = {(k, k % 60, s) for k, s in enumerate(scores) if s >= D.threshold(len(items[k % 60].split()))}
    kept = {k for k, j, _ in want if k < 120 or len(items[j].split()) > 23}  # three words in a row
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in D.leaks(table, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(kept) > 100 and got <= want and {w for w in want if w[0] in kept} <= got


def test_common_passages_and_blocks(spark, monkeypatch):
    """A passage that all texts share is found in all; several blocks of the benchmark give the same as one."""
    rng = random.Random(3)
    passage = texts(rng, 1, 30, 31)[0]
    docs = [f"{a} {passage} {b}" for a, b in zip(texts(rng, 40, 5, 30), texts(rng, 40, 5, 30), strict=True)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate([passage, *texts(rng, 5, 20, 30)])), "item_id long, text string")
    one = sorted(tuple(r) for r in D.leaks(table, bench).collect())
    assert [r[:2] for r in one] == [(i, 0) for i in range(40)]
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert sorted(tuple(r) for r in D.leaks(table, bench).collect()) == one


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert D.leaks(none, bench).count() == 0 and D.leaks(docs, bench).count() == 0 and D.clean(docs, bench).count() == 2
