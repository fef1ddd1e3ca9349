import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveworks.llm import langid

SF = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    net = langid.ByteGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, sizes, y = rng.integers(97, 105, (5, 6)).astype(np.uint8), np.array([6, 3, 1, 4, 2]), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, sizes, y)
    for k, a in net.p.items():
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in a.shape)
            i = (int(x[0, 2]), i[1]) if k[0] == "E" else i
            old = a[i]
            a[i] = old + 1e-5
            up = net.gradients(x, sizes, y)[0]
            a[i] = old - 1e-5
            down = net.gradients(x, sizes, y)[0]
            a[i] = old
            assert abs((up - down) / 2e-5 - grads[k][i]) < 1e-6


def test_positions_do_not_depend_on_padding():
    net = langid.ByteGRU(2)
    word = np.frombuffer(b"voici", np.uint8)
    a = net.log_probabilities(word[None, :], np.array([5]))
    padded = np.zeros((1, 24), np.uint8)
    padded[0, :5] = word
    assert np.allclose(a[0], net.log_probabilities(padded, np.array([5]))[0, :5], atol=1e-5)


def test_windows_equal_a_plain_reading(spark, docs, monkeypatch):
    """Every position by itself: a recurrence written out for single bytes, over the window that the position is in."""
    monkeypatch.setattr(langid, "CORE", 16)
    monkeypatch.setattr(langid, "CONTEXT", 5)
    monkeypatch.setattr(langid, "ROWS", 3)
    net = langid.ByteGRU(3, 4)

    def state(text, way):
        h, e, u, s = 4, net.p[f"E{way}"], net.p[f"U{way}"], np.zeros(4)
        for c in text if way == "f" else text[::-1]:
            zr = 1 / (1 + np.exp(-(e[c, : 2 * h] + s @ u[:, : 2 * h])))
            n = np.tanh(e[c, 2 * h :] + (zr[h:] * s) @ u[:, 2 * h :])
            s = n + zr[:h] * (s - n)
        return s

    texts = ["", "voici 12 mots\n et la fin; ", "x" * 40, "é ü", "ab " * 21]
    data, offsets = langid.buffers(pa.array(texts))
    got = langid.pooled(net, data, offsets)
    for d, text in enumerate(t.encode() for t in texts):
        want = np.zeros(3)
        for k in range(len(text)):
            lo, hi = max(0, k // 16 * 16 - 5), min(len(text), k // 16 * 16 + 16 + 5)
            a = np.concatenate([state(text[lo : k + 1], "f"), state(text[k:hi], "b")]) @ net.p["V"] + net.p["c"]
            want += a - np.log(np.exp(a).sum())
        assert np.allclose(got[d], want, atol=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.98


def test_odd_tables(spark, docs):
    assert langid.train(docs([])) == ([], None)
    texts = ["the house", None, "", "123 --- 4", "« — »", "THE HOUSE", "the house", "é" * 3000]
    table = docs(texts, ids=[0, 1, 2, 3, 4, 5, None, 7])
    none = langid.predict(table, ([], None)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    rows = langid.predict(table, langid.train(table)).collect()
    assert len(rows) == 8
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert got[0]["lang_pred"] == got[5]["lang_pred"] == got[None]["lang_pred"] == "en" and got[0]["score"] == got[5]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1) for r in rows)


def test_held_out_rows_are_not_learned(spark, docs):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:9]
    assert langid.train(docs(["a text"] * 9, ids=ids)) == ([], None)
