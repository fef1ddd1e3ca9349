import collections
import hashlib
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sieveworks.llm import mixing


def schedule_of(q):
    """Earliest deadline first by simulation."""
    p, done, out = sum(q), [0] * len(q), []
    for t in range(p):
        ready = [(-(-(d + 1) * p // q[i]), i) for i, d in enumerate(done) if d < q[i] and d * p // q[i] <= t]
        i = min(ready)[1]
        out.append((t, i, done[i]))
        done[i] += 1
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7))
def test_schedule(spark, q):
    quota = spark.createDataFrame([(f"s{i}", 1, x) for i, x in enumerate(q)], "src string, n long, q long")
    rows = mixing.schedule(quota).collect()
    assert sorted((r["slot"], int(r["src"][1:]), r["j"]) for r in rows) == schedule_of(q)
    p, placed = sum(q), [0] * len(q)
    for r in sorted(rows, key=lambda r: r["slot"]):
        assert r["release"] <= r["slot"] < r["deadline"]
        for i, m in enumerate(placed):
            assert abs(m - r["slot"] * q[i] / p) < 1
        placed[int(r["src"][1:])] += 1


def test_every_document_once_and_on_target(spark):
    sizes = {"a": 700, "b": 90, None: 40, "c": 3}
    rows = [(k * 1000 + i, s, f"t{i}", -1) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_position long")
    got = sorted(mixing.mix(df, block_docs=4).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(len(rows)))
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    total = sum(n**0.5 for n in sizes.values())
    q = {s: max(1, round(n**0.5 / total * 1000)) for s, n in sizes.items()}
    seen = collections.Counter()
    for k, r in enumerate(got):
        if any(seen[s] >= n for s, n in sizes.items()):
            break  # from the first source that has run out on
        if k % 4 == 0:
            assert all(abs(seen[s] - k * q[s] / sum(q.values())) < 4 for s in sizes)
        seen[r["source"]] += 1
    of_a = [r["doc_id"] for r in got if r["source"] == "a"]
    assert of_a == sorted(of_a, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))


def test_given_weights(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)], "doc_id long, source string")
    got = mixing.mix(df, weights={"a": 3, "b": 1}, block_docs=1, slots=4).orderBy("mix_position").limit(40).collect()
    assert sum(r["source"] == "a" for r in got) == 30


def test_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    assert sorted(r["mix_position"] for r in mixing.mix(df).collect()) == [0, 1, 2, 3]
    assert mixing.mix(df.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    plan = mixing.mix(spark.range(5).selectExpr("id doc_id", "'a' source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan



def test_columns_of_any_name_are_passed_on(spark):
    names = ["_src", "_own", "period", "slot", "src", "q", "doc", "cell", "r", "rank", "blocks", "round", "a.b", "x`y", "mix_slot"]
    rows = [(i, f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    got = mixing.mix(spark.createDataFrame(rows, f"doc_id long, source string, {fields}"), block_docs=4)
    assert got.columns == ["doc_id", "source", *names[:-1], *mixing.ADDED]
    assert sorted(tuple(r)[:-5] for r in got.collect()) == [r[:-1] for r in rows]
    assert sorted(r["mix_position"] for r in got.collect()) == list(range(60))


def test_many_sources(spark):
    """As many sources as documents, nearly: the work grows with the blocks, not with sources times slots or documents."""
    began = time.monotonic()
    df = spark.range(12000).selectExpr("id as doc_id", "if(id < 4000, 'big', concat('s', id % 5000)) as source")
    got = mixing.mix(df).select("mix_position", "mix_slot", "mix_deadline").collect()
    assert sorted(r[0] for r in got) == list(range(12000)) and all(r[1] < r[2] for r in got)
    assert time.monotonic() - began < 60
