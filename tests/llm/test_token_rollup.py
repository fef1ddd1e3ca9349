import os

import pytest

from sieveworks.llm import token_rollup as R

pytestmark = pytest.mark.skipif(not os.path.exists(R.VOCABULARY), reason="no vocabulary")
SCHEMA = "op string, doc_id long, source string, lang string, text string, seq long"


def plain(state):
    enc, out = R.encoder(R.VOCABULARY), {}
    for source, lang, text in state:
        k = (source, lang, "byte_bpe_50k")
        a = out.get(k, (0, 0, 0))
        out[k] = (a[0] + 1, a[1] + len(enc.encode_ordinary(text or "")), a[2] + len(text or ""))
    return out


def totals(rollup):
    return {tuple(r[:3]): tuple(r[3:]) for r in rollup.totals().collect()}


def test_deltas_equal_a_recount(spark, tmp_path):
    roll = R.TokenRollup(spark, str(tmp_path / "t"))
    assert totals(roll) == {}
    one = [("insert", 1, "a", "en", "hello world", 0), ("insert", 2, "a", "en", None, 0), ("insert", 3, None, "fr", "été " * 50, 0), ("insert", None, "b", None, "no id", 0), ("insert", 4, "b", "en", "old", 0), ("insert", 4, "b", "en", "newer one", 1)]
    assert roll.commit("x", spark.createDataFrame(one, SCHEMA))
    state = {1: ("a", "en", "hello world"), 2: ("a", "en", None), 3: (None, "fr", "été " * 50), 4: ("b", "en", "newer one")}
    loose = [("b", None, "no id")]
    assert totals(roll) == plain([*state.values(), *loose])
    assert not roll.commit("x", spark.createDataFrame(one, SCHEMA))
    assert totals(roll) == plain([*state.values(), *loose])
    two = [("delete", 1, None, None, None, 0), ("revise", 3, "c", "fr", "court", 0), ("delete", 99, None, None, None, 0), ("insert", 2, "a", "en", "now text", 0)]
    assert roll.commit("y", spark.createDataFrame(two, SCHEMA))
    state = {2: ("a", "en", "now text"), 3: ("c", "fr", "court"), 4: state[4]}
    assert totals(roll) == plain([*state.values(), *loose])
    assert roll.commit("z", spark.createDataFrame([], SCHEMA))
    assert totals(roll) == plain([*state.values(), *loose])


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    roll = R.TokenRollup(spark, str(tmp_path / "t"))
    roll.commit("x", spark.createDataFrame([("insert", 1, "a", "en", "one", 0)], SCHEMA))
    spark.createDataFrame([("a", "en", "t", 9, 9, 9)], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long").write.parquet(f"{tmp_path}/t/data/dead/delta")
    assert totals(roll) == plain([("a", "en", "one")])


def test_long_runs_are_counted():
    enc = R.encoder(R.VOCABULARY)
    for text in ("a" * 200_000, " " * 200_000, "\n\n  \n" * 20_000):
        assert R.count_tokens(enc, text) > 0


def test_compacting_changes_nothing(spark, tmp_path):
    roll = R.TokenRollup(spark, str(tmp_path / "t"))
    assert not roll.compact()
    roll.commit("x", spark.createDataFrame([("insert", i, "a", "en", f"text {i}", 0) for i in range(5)] + [("insert", None, "b", "en", "loose", 0)], SCHEMA))
    roll.commit("y", spark.createDataFrame([("delete", 1, None, None, None, 0), ("revise", 2, "b", "en", "longer text now", 0)], SCHEMA))
    before = totals(roll)
    assert roll.compact() and not roll.compact() and totals(roll) == before
    assert roll.batches() == ["x", "y"] and not roll.commit("x", spark.createDataFrame([("insert", 9, "a", "en", "no", 0)], SCHEMA))
    assert roll.commit("z", spark.createDataFrame([("revise", 2, "a", "en", "two", 0), ("insert", 1, "a", "en", "back", 0)], SCHEMA))
    assert totals(roll) == plain([("a", "en", f"text {i}") for i in (0, 3, 4)] + [("a", "en", "two"), ("a", "en", "back"), ("b", "en", "loose")])
    assert R.TokenRollup(spark, str(tmp_path / "t")).batches() == ["x", "y", "z"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer takes the number, or commits the same batch, while one is still counting."""
    one, two = (R.TokenRollup(spark, str(tmp_path / "t")) for _ in range(2))
    batch = lambda op, text: spark.createDataFrame([(op, 1, "a", "en", text, 0)], SCHEMA)
    real, done = R.TokenRollup._publish, []

    def late(self, *args):
        if self is one and not done:
            done.append(1)
            assert two.commit("other", batch("insert", "the other writer's"))
        return real(self, *args)

    monkeypatch.setattr(R.TokenRollup, "_publish", late)
    assert one.commit("mine", batch("revise", "mine"))
    assert one.batches() == ["other", "mine"] and totals(one) == plain([("a", "en", "mine")])
    done.clear()

    def same(self, *args):
        if self is one and not done:
            done.append(1)
            assert two.commit("same", batch("revise", "same"))
        return real(self, *args)

    monkeypatch.setattr(R.TokenRollup, "_publish", same)
    assert not one.commit("same", batch("revise", "same"))
    assert totals(two) == plain([("a", "en", "same")])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_equals_a_recount(spark):
    from sieveworks.llm import registry

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {tuple(r[c] for c in R.KEYS): tuple(r[c] for c in R.TOTALS) for r in registry.op2_token_rollup(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain([(r["source"], r["lang"], r["text"]) for r in docs])
