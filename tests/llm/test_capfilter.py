import numpy as np

from sieveworks.llm import capfilter

SCHEMA = "vec_id long, embedding array<float>, label int, node long, unit string"


def brute(rows):
    """Links, components and kept by all pairs in double precision."""
    vectors = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in (v or [])], float)
        vectors.append((i, x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None))
    n = len(vectors)
    links = [[j for j in range(n) if j != i and vectors[i][1] is not None and vectors[j][1] is not None and len(vectors[i][1]) == len(vectors[j][1]) and vectors[i][1] @ vectors[j][1] >= 0.95] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                label[i] = min(label[i], label[j], key=lambda k: vectors[k][0])
    return sorted((vectors[i][0], len(links[i]), vectors[label[i]][0]) for i in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)
    got = capfilter.links(df).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


def test_equals_brute_force_with_a_dense_group(spark):
    rng = np.random.default_rng(0)
    near = lambda c, s: (c + rng.normal(0, s, 32)).astype(np.float32).tolist()
    centre, other = rng.normal(size=32), rng.normal(size=32)
    rows = [near(rng.normal(size=32), 0) for _ in range(40)]
    rows += [near(centre, s) for s in np.linspace(0.02, 0.5, 120)] + [near(other, 0.25) for _ in range(30)] + [near(centre, 0.01)] * 5
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, []), (13, [1.0, 0.0, 0.0]), (14, [1.0, 0.0]), (15, [-1.0, 0.0]), (16, [1e-30, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_recall_of_filters_alone():
    """Of pairs just at the limit at least 99 in 100 share a filter."""
    rng = np.random.default_rng(1)
    code = capfilter.ProductCode(64, 256)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(600, 64))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]
    a, b = code.decode(x), code.decode(y)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) >= 0.99
    assert all((len(p) >= capfilter.LEAST) for p in a)


def test_decoding_lists_all_exceeding_filters():
    code = capfilter.ProductCode(16, 64)
    x = np.random.default_rng(2).normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = code._scores(x)
    for k, got in enumerate(code.decode(x)):
        whole = (a[k][:, None] + b[k][None, :]).ravel()
        want = np.flatnonzero(whole >= code.threshold)
        assert set(want) <= set(got) and (len(want) < capfilter.LEAST or set(got) == set(want))
