import collections
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveworks.llm import quality

SF = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out")
    rows = got.select("quality", "predicted").collect()
    assert np.mean([r[0] == r[1] for r in rows]) >= 0.95
    assert all(r[1] == 1 for r in rows if r[0] == 1)


def test_inputs_do_not_depend_on_the_batch():
    texts = ["One two. Three!", "", None, "# $ % é", "word " * 5000]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], whole[i])
    assert np.isfinite(whole).all()


def test_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    net = quality.PUNet(np.zeros(4), np.ones(4))
    x, w = rng.normal(size=(6, 4)), rng.normal(size=6)
    g = net._gradient(x, w)
    for k, a in net.p.items():
        i = tuple(0 for _ in a.shape)
        old = a[i]
        a[i] = old + 1e-6
        up = (net.margin(x) * w).sum()
        a[i] = old - 1e-6
        down = (net.margin(x) * w).sum()
        a[i] = old
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-5


def test_odd_tables(spark, docs):
    assert quality.train(docs(["a b"]), labels_of(spark, [])) is None
    empty = quality.score(docs([]), None)
    assert empty.count() == 0
    good = ["The house stands near the old river and people walk there every day."] * 20
    bad = ["### $$$ %%% ### $$$ %%%"] * 20
    table = docs([*good, *bad, None, ""], ids=[*range(40), None, 7])
    net = quality.train(table, labels_of(spark, [(i, 1 if i < 20 else 0, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)]))
    rows = quality.score(table, net).collect()
    assert len(rows) == 42 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0) for r in rows)
    kept = quality.accept(table, net)
    assert kept.columns == table.columns and {r["text"] for r in kept.collect()} >= {good[0]}


def test_held_out_labels_are_not_learned(spark, docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0][:10]
    assert quality.train(docs(["text here"] * 10, ids=ids), labels_of(spark, [(i, 1, 0) for i in ids])) is None


def plain_features(text):
    """The inputs of one text, counted character by character and word by word."""
    raw, low = (text or "").encode(), (text or "").lower().encode()
    words = [w for w in re.split(rb"[^0-9A-Za-z_\x80-\xff]+", low) if w]
    n, total = max(1, len(words)), max(1, len(raw))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    distinct, most = len(set(words)), max(collections.Counter(words).values(), default=0)
    spread = max(0, sum(s * s for s in sizes) / n - mean**2) ** 0.5
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out = [math.log1p(len(words)), mean, spread, upper / max(1, upper + lower), distinct / n, math.log(max(1, distinct)) / math.log(n + 1), (most / n) ** 0.5, 1 - len(set(grams)) / max(1, len(grams)), math.log1p(n / (1 + raw.count(b"."))), sum(s <= 3 for s in sizes) / n, (doubled / n) ** 0.5]
    return out + [(sum(c in g for c in raw) / total) ** 0.5 for g in quality._GROUPS]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_a_plain_computation(spark):
    """Every score of the query from plainly counted inputs and the network written out."""
    from sieveworks.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in registry.op5_pu_quality(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = [min(8, max(-4, (v - m) / s)) for v, m, s in zip(plain_features(r["text"]), net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(a * b for a, b in zip(x, net.p["A"][:, k], strict=True)) + net.p["a"][k]) for k in range(quality.HIDDEN)]
        margin = sum(h * b for h, b in zip(hidden, net.p["B"], strict=True)) + net.p["b"][0]
        want, mine = 1 / (1 + math.exp(-margin)), got[r["doc_id"]]
        assert abs(mine["score"] - want) < 1e-6 and mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert mine["predicted"] == int(mine["score"] >= 0.3)


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(3)
    start = lambda: quality.PUNet(np.zeros(2), np.ones(2))
    for share in (0.3, 0.6, 0.9):
        draw = lambda n, kind: rng.normal(3.0 * kind, 1, (n, 2))
        web = np.concatenate([draw(int(8000 * share), 1), draw(8000 - int(8000 * share), 0)])
        got = quality.estimated_prior(draw(3000, 1), web, lambda net: quality._bins(net.scores(web)), start)
        assert share - 0.12 < got < share + 0.02
    assert quality.estimated_prior(draw(1, 1), web, None, start) == 0.5
