import numpy as np
import pytest

from quillstream.llm import neighbours
from quillstream.llm.hnsw import build, search
from quillstream.llm.neighbours import Layout, fit_cells, most_similar, near_pairs, nearest_cells, recall

SCHEMA = "vid long, emb array<float>, shard int, home string, vector string"


def planted(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[: n // 3] = base[n // 3 : 2 * (n // 3)] + 0.25 * rng.normal(size=(n // 3, dim))
    return base


def frame(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b") for i, v in zip(ids, vectors)], SCHEMA)


def exact_pairs(x, ids, k, least):
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sims = np.round(u @ u.T, 12)
    np.fill_diagonal(sims, -2)
    out = set()
    for r in range(len(u)):
        for j in np.lexsort((ids, -sims[r]))[:k]:
            if sims[r, j] >= least:
                out.add((min(ids[r], ids[j]), max(ids[r], ids[j])))
    return out


def test_graph_recall():
    x = planted(3000).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, _ = search(build(x, 16, 48), x, 5, 64, own=np.arange(len(x)))
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(near, want)]) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 20])
def test_tiny_graphs(n):
    x = planted(30)[:n].astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, _ = search(build(x), x, 5, own=np.arange(n))
    assert (near >= 0).sum() == n * min(5, n - 1)


def test_pairs_over_several_shards(spark):
    x = planted()
    ids = np.arange(len(x)) * 7
    got = {tuple(r) for r in most_pairs(frame(spark, x, ids))}
    want = exact_pairs(x, ids, 5, 0.9)
    assert got <= want and len(got) >= 0.97 * len(want)


def most_pairs(df):
    rows = most_similar(df, "vid", "emb", 5, 64, **neighbours.CLOSE | {"shard": 300}).collect()
    return {(min(r["vector_id"], r["neighbour_id"]), max(r["vector_id"], r["neighbour_id"])) for r in rows}


def test_crowds_of_equal_vectors(spark):
    x = planted(300)
    x[100:250] = x[99]
    got = {tuple(r) for r in near_pairs(frame(spark, x), "vid", "emb").collect()}
    assert got == exact_pairs(x, np.arange(300), 5, 0.9)


def test_crowds_of_one_direction_and_mixed_lengths(spark):
    x = planted(300)
    x[100:250] = x[99]
    x[100:250:2] *= np.random.default_rng(3).uniform(0.1, 9, size=(75, 1))
    x[20:45] = x[19] * np.arange(2, 27)[:, None] / 7  # no two are equal
    want = exact_pairs(x, np.arange(300), 5, 0.9)
    assert {tuple(r) for r in near_pairs(frame(spark, x), "vid", "emb").collect()} == want
    assert most_pairs(frame(spark, x)) == want
    some = most_similar(frame(spark, x), "vid", "emb", every=50).where("cosine = 1").collect()
    assert {(r["vector_id"], r["neighbour_id"]) for r in some if r["vector_id"] == 150} == {(150, i) for i in range(99, 104)}


def test_dirty_vectors_and_empty_table(spark):
    good = planted(40)
    rows = [*good, None, good[0][:10], [None, *good[1][1:]], [float("nan"), *good[2][1:]], [float("inf"), *good[3][1:]], np.zeros(64), 1e-30 * good[4], 3 * good[5]]
    ids = [*range(40), 100, 101, 102, 103, 104, 105, 106, 107]
    df = frame(spark, rows, ids)
    got = {tuple(r) for r in near_pairs(df.unionByName(df), "vid", "emb").collect()}
    assert {(4, 106), (5, 107)} <= got and not {i for p in got for i in p} & set(range(100, 106))
    assert near_pairs(frame(spark, []), "vid", "emb").collect() == []
    assert near_pairs(frame(spark, [np.zeros(64), None]), "vid", "emb").collect() == []


def test_recall_is_measured_against_brute_force(spark):
    df = frame(spark, planted())
    found = most_similar(df, "vid", "emb", every=100, shard=400)
    assert {r["vector_id"] % 100 for r in found.select("vector_id").collect()} == {0}
    row = recall(df, "vid", "emb", found, block=500).first()
    assert row["queries"] == 15 and row["expected"] == 75 and row["recall"] >= 0.9
    close = recall(df, "vid", "emb", most_similar(df, "vid", "emb", every=10, **neighbours.CLOSE | {"shard": 400}), every=10, least=0.9).first()
    assert close["recall"] >= 0.97 and close["wrong"] <= 1


def test_cells_in_two_levels_and_shards_with_many_guests(spark, monkeypatch):
    x = planted()
    want = exact_pairs(x, np.arange(len(x)), 5, 0.9)
    monkeypatch.setattr(neighbours, "FLAT", 3)
    got = most_pairs(frame(spark, x))
    assert got <= want and len(got) >= 0.95 * len(want)
    monkeypatch.setattr(neighbours, "FLAT", 1024)
    real = Layout.of
    monkeypatch.setattr(Layout, "of", staticmethod(lambda *a: Layout(real(*a).centres, real(*a).parts + 1, real(*a).copies + 2, a[5], a[6])))
    copied = most_pairs(frame(spark, x))
    assert copied <= want and len(copied) >= 0.97 * len(want)


def test_the_cells_asked_are_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres, share = fit_cells(x, 200)
    assert abs(share.sum() - 1) < 1e-9 and np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5)
    top, close = nearest_cells(x, centres, 6, 0.25)
    sims = x @ centres.T
    assert top.shape == (4000, 6) and close[:, 0].all() and (np.take_along_axis(sims, top, 1)[:, 0] >= sims.max(1) - 1e-6).all()
    layout = Layout.of(centres, share, x, 10**6, 1000, 6, 0.25, 1.0)
    assert (layout.parts >= 1).all() and layout.slots >= 10**6 / 2000
