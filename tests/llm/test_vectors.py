import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import vectors as V

SCHEMA = "id_a long, id_b long, model string, vector array<float>, dim int, rank int, cosine string"


def rows(x, model="m", start=0):
    return [(start + i, 0, model, [float(v) for v in r], len(r), 7, "x") for i, r in enumerate(x)]


def brute(data, k, least=-2.0):
    out = {}
    for model in {r[2] for r in data}:
        own = sorted((r for r in data if r[2] == model), key=lambda r: (r[0], r[1]))
        x = np.array([r[3] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for i, r in enumerate(own):
            order = [j for j in np.lexsort((np.arange(len(own)), -np.round(s[i], 6))) if j != i and s[i, j] >= least - 1e-9][:k]
            out[(r[0], r[1])] = {(own[j][0], own[j][1]) for j in order}
    return out


def run(spark, data, **how):
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in V.most_similar(df, **how).collect():
        got.setdefault((r.q_a, r.q_b), set()).add((r.d_a, r.d_b))
    return got


def near_pairs(n, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    return np.concatenate([base, base[: n // 4] + 0.1 * rng.normal(size=(n // 4, dim))]) * rng.uniform(0.1, 9, (n + n // 4, 1))


def test_close_pairs_are_found(spark):
    data = rows(near_pairs(1600)) + rows(near_pairs(400, 2, 8), "other", 10_000)
    want, got = brute(data, 5, 0.9), run(spark, data, k=5, least=0.9, list_rows=32)
    total = sum(map(len, want.values()))
    assert total > 400
    assert sum(len(want[q] & got.get(q, set())) for q in want) >= 0.98 * total
    assert all(got[q] <= want[q] for q in got)


def test_recall_of_all_neighbours_with_wide_probes(spark):
    data = rows(near_pairs(1600))
    want = brute(data, 10)
    got = run(spark, data, k=10, list_rows=64, queries=F.col("id_a") % 20 == 0, probes=16, replicas=4)
    assert set(got) == {q for q in want if q[0] % 20 == 0}
    assert np.mean([len(want[q] & got[q]) / 10 for q in got]) >= 0.9


def test_walk_finds_nearest_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 16)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = V.fit(x, 8000, list_rows=16)
    assert len(lists.centroids) == 500
    ids, sims = lists.nearest(x[:500], 12)
    true = np.argsort(-(x[:500] @ lists.centroids.T), axis=1)[:, :4]
    assert np.mean([len(set(a[:8]) & set(b)) / 4 for a, b in zip(ids, true)]) > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    assert np.bincount(np.argmax(x @ lists.centroids.T, axis=1), minlength=500).max() < 10 * 16


def test_blocks_are_exact_and_recall_counts(spark, monkeypatch):
    data = rows(near_pairs(400)) + rows(near_pairs(40, 2, 8), "other", 10_000)
    df, asked = spark.createDataFrame(data, SCHEMA), F.col("id_a") % 10 == 0
    exact = V.exact_similar(df, k=5, queries=asked, query_block=16, data_block=64)
    got = {}
    for r in exact.collect():
        got.setdefault((r.q_a, r.q_b), set()).add((r.d_a, r.d_b))
    want = brute(data, 5)
    assert got == {q: want[q] for q in want if q[0] % 10 == 0}
    r = V.recall(exact.where("rank <= 4"), exact).first()
    assert r.n_queries == 55 and r.recall == 0.8 and r.recall_close == 1.0


def test_unusable_vectors_and_nulls(spark):
    nan = float("nan")
    data = [(1, 0, "m", [1.0, 0.0], 2, 0, ""), (2, 0, "m", [2.0, 0.0], 2, 0, ""), (3, 0, "m", [0.0, 0.0], 2, 0, ""), (4, 0, "m", None, 2, 0, ""), (5, 0, "m", [1.0], 2, 0, ""), (6, 0, "m", [nan, 1.0], 2, 0, ""), (None, 0, "m", [1.0, 0.0], 2, 0, ""), (7, 0, None, [1.0, 0.0], 2, 0, ""), (8, 0, None, [1.0, 0.1], 2, 0, ""), (9, 0, "alone", [1.0, 0.0], 2, 0, ""), (10, 0, "m", [None, 1.0], 2, 0, ""), (11, 0, "m", [1.0, 0.0], None, 0, "")]
    assert run(spark, data, k=3) == {(1, 0): {(2, 0)}, (2, 0): {(1, 0)}, (7, 0): {(8, 0)}, (8, 0): {(7, 0)}}
    assert run(spark, [], k=3) == {}


@pytest.mark.parametrize("block", [4096, 16])
def test_a_third_are_copies(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    x = np.concatenate([near_pairs(160), np.tile([[1.0] * 16], (100, 1))])
    data = rows(x)
    got = run(spark, data, k=5, least=0.9, list_rows=32)
    first = [(200 + i, 0) for i in range(100)]
    for i, q in enumerate(first):
        assert got[q] == set([f for f in first if f != q][:5]), i


def test_pairs_smaller_key_first(spark):
    df = spark.createDataFrame(rows([[1, 0], [1, 0.01], [0, 1]]), SCHEMA)
    assert [tuple(r)[:4] for r in V.similar_pairs(df, k=2, least=0.9).collect()] == [(0, 0, 1, 0)]


def test_latest_chunk_counts(spark):
    df = spark.createDataFrame([(1, 0, "old", 1.0), (1, 0, "new", 2.0), (1, 0, "new", 2.0), (1, 1, "x", None)], "node_id long, chunk_idx int, t string, updated_at double")
    assert sorted(tuple(r) for r in V.latest_chunks(df, "t").collect()) == [(1, 0, "new"), (1, 1, "x")]


def test_few_usable_vectors_among_many_rows(spark):
    """The sample of the raw rows holds none of them, and they are found all the same."""
    rng = np.random.default_rng(12)
    few = rows(rng.normal(size=(6, 8)), "rare", 5_000)
    bad = [(i, 0, "rare", None if i % 2 else [0.0] * 8, 8, 7, "x") for i in range(3_000)]
    df = spark.createDataFrame(few + bad + rows(near_pairs(20, 5, 8), "other", 9_000), SCHEMA)
    index = V.build_index(df, fit_rows=2)
    assert {m.split("\u0001")[0] for m in index} == {"rare", "other"}
    got = run(spark, few + bad, k=3, fit_rows=2)
    assert got == brute(few, 3)


def test_second_level_of_lists(spark):
    data = rows(near_pairs(3200, 4))
    df = spark.createDataFrame(data, SCHEMA)
    index = V.build_index(df, fit_rows=128, list_rows=16)
    lists = next(iter(index.values()))
    assert lists.sub is not None and len(lists.sub) > 4 * len(lists.centroids) and len(lists.blocks) == len(lists.sub)
    want = brute(data, 5, 0.9)
    got = {}
    for r in V.most_similar(df, k=5, least=0.9, index=index).collect():
        got.setdefault((r.q_a, r.q_b), set()).add((r.d_a, r.d_b))
    total = sum(map(len, want.values()))
    assert sum(len(want[q] & got.get(q, set())) for q in want) >= 0.9 * total
    assert all(got[q] <= want[q] for q in got)
