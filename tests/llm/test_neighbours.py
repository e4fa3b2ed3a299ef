import numpy as np

from geoloom.llm import neighbours as N


def test_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = N.hilbert_key(grid, bits)
        order = np.argsort(key)
        assert sorted(key.tolist()) == list(range(len(key)))
        assert np.abs(np.diff(grid[order], axis=0)).sum(1).max() == 1


def test_codes_are_lossless():
    import pandas as pd

    rng = np.random.default_rng(1)
    halves, floats = rng.standard_normal((5, 8)).astype(np.float16).astype(np.float32), rng.standard_normal((5, 8)).astype(np.float32)
    for x in (halves, floats, np.concatenate((halves, floats))):
        assert np.array_equal(N.decode(pd.Series(N.encode(pd.Series(list(x)))), 8), x)


def data(n=1500, groups=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32)).astype(np.float32)
    for g in range(groups):
        x[g * 6 : g * 6 + 6] = x[g * 6] + 0.08 * rng.standard_normal((6, 32))
    x[-40:] = x[-1]  # a group of exact copies
    return [(f"k{i:05}", [float(v) for v in row]) for i, row in enumerate(x)]


def exact(rows, k, least):
    keys = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(keys)):
        for j in np.lexsort((np.arange(len(keys)), -s[i]))[:k]:
            if s[i, j] >= least:
                out.add((keys[i], keys[j]))
    return out


def test_recall_against_brute_force(spark):
    rows = data()
    dirty = [("null", None), ("empty", []), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32), (None, [1.0] * 32), rows[3]]
    df = spark.createDataFrame(rows + dirty, "key string, v array<float>")
    got = N.similar_vectors(df, "key", "v", k=5, least=0.95).collect()
    want = exact(rows, 5, 0.95)
    have = {(r.key_a, r.key_b) for r in got}
    assert len(have & want) >= 0.99 * len(want) and not have - want
    assert max(r["rank"] for r in got) <= 5


def test_query_set_is_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK_MB", 0.02)
    rows = data(400, 10, 3)
    df = spark.createDataFrame(rows, "key string, v array<float>")
    got = {(r.key_a, r.key_b) for r in N.nearest_of_queries(df, df.where("key like '%0'"), "key", "v", k=5).collect()}
    assert got == {p for p in exact(rows, 5, -1) if p[0].endswith("0")}


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "key string, v array<float>")
    assert N.similar_vectors(df, "key", "v").count() == 0 and N.nearest_of_queries(df, df, "key", "v").count() == 0
    one = spark.createDataFrame([("a", [1.0, 0.0])], "key string, v array<float>")
    assert N.similar_vectors(one, "key", "v").count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1600, 32))
    x[:1200] = x[0] + 0.1 * rng.standard_normal((1200, 32))  # far more than a window holds, cosines about 0.99
    x[1200:1220] = x[0] + 0.25 * rng.standard_normal((20, 32))  # its fringe, about 0.95
    rows = [(f"k{i:05}", [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    got = {(r.key_a, r.key_b) for r in N.similar_vectors(df, "key", "v", k=5, least=0.95).collect()}
    assert got == exact(rows, 5, 0.95)


def test_groups_larger_than_k_keep_their_best_without_a_threshold(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 32))
    for g in range(20):
        x[g * 9 : g * 9 + 9] = x[g * 9] + 0.12 * rng.standard_normal((9, 32))
    rows = [(f"k{i:05}", [float(v) for v in row]) for i, row in enumerate(x)]
    got = N.similar_vectors(spark.createDataFrame(rows, "key string, v array<float>"), "key", "v", k=5).collect()
    want = {p for p in exact(rows, 5, 0.9)}
    assert len({(r.key_a, r.key_b) for r in got} & want) >= 0.99 * len(want) > 800
