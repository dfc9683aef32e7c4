import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import forest as G


def clusters(n, per, seed=0, noise=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // per, 64))
    return (np.repeat(c, per, axis=0) + noise * rng.standard_normal((n // per * per, 64))).astype(np.float32)


def brute(ids, x, k):
    w = x.astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    s = -np.rint(w @ w.T * 1e6)
    np.fill_diagonal(s, 9e9)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, s[i]))[:k]] for i in range(len(ids))}


def frame(spark, ids, x, g="a"):
    return spark.createDataFrame([(int(i), g, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, dataset string, vec array<float>")


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, {})[r.other_id] = r.millionths
    return out


def recall(got, want):
    return sum(len(set(got.get(i, {})) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


def test_recall_with_cells_and_buckets(spark, monkeypatch):
    """Small limits, so that the fitted trees, cells, descents and ascents are all at work."""
    for name, v in (("CELL", 500), ("LEAST", 60), ("ASK", 1500), ("WIDE", 300)):
        monkeypatch.setattr(G, name, v)
    x, ids = clusters(4000, 20), np.arange(4000) * 3
    got = lists(G.neighbours(frame(spark, ids, x)))
    want = brute(ids, x, 5)
    assert recall(got, want) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_company_counts_rows_that_share_a_prefix():
    c = np.random.default_rng(1).integers(0, 1 << 10, 300)
    got = G.company(c, 10, 10)
    for level in range(11):
        p = c >> (10 - level)
        assert (got[:, level] == (p[:, None] == p[None, :]).sum(axis=1)).all()


def test_the_ascent_is_synchronous_over_the_trees():
    """One tree parts a vector early and gives few; at the level where all trees together hold
    enough, the ascent stops in all of them."""
    one, two = np.array([1000, 400, 3, 1, 1]), np.array([1000, 900, 700, 60, 1])
    packed = [(0, G.packed_counts(one)[None]), (0, G.packed_counts(two)[None])]
    assert [int(G.ascend(packed, ask)[0]) for ask in (1, 50, 600, 1200, 1900, 9999)] == [4, 3, 2, 1, 0, 0]
    # a tree whose cell's prefix is longer has no more beyond it
    assert G.ascend([(0, G.packed_counts(one)[None]), (2, G.packed_counts(np.array([[700, 60, 1]])))], 1000).tolist() == [1]


def test_compare_takes_all_that_share_the_prefix():
    rng = np.random.default_rng(2)
    x, c, level = rng.standard_normal((200, 8)).astype(np.float32), [rng.integers(0, 1 << 6, 200) for _ in range(3)], rng.integers(0, 5, 200)
    got = G.compare(x, x, c, c, level, 6, 200)
    near = np.zeros((200, 200), bool)
    for codes in c:
        near |= (codes[:, None] >> (6 - level)[:, None]) == (codes[None, :] >> (6 - level)[:, None])
    assert set(got.tolist()) == set(np.flatnonzero(near.ravel()).tolist())


def test_cells_are_cut_by_their_count():
    assert G.cell_depths(np.array([G.CELL])).tolist() == [0] and G.cell_depths(np.array([4 * G.CELL])).tolist() == [2]
    n = np.array([G.CELL, G.CELL // 4, 100, 5 * G.CELL])
    assert G.cell_depths(n).tolist() == [2, 2, 2, 5]  # leaf 3 goes on with three bits of its string
    assert G.cell_depths(np.array([2 * G.CELL, 10])).tolist() == [0, 0]  # its small part would be too lonely
    leaf = np.array([0, 3, 3])
    assert len(set(G.cells(leaf, np.array([5, 0, (1 << G.BITS) - 1]), np.array([2, 2, 2, 5])).tolist())) == 3


def test_scaled_copies_are_copies(spark):
    """Half of the rows lie on one ray, at different lengths."""
    x = clusters(600, 6)
    x[::2] = x[0] * np.random.default_rng(5).uniform(0.1, 30, (300, 1)).astype(np.float32)
    ids = np.arange(600)
    got = lists(G.neighbours(frame(spark, ids, x)))
    want = brute(ids, x, 5)
    assert recall(got, want) >= 0.99 and got.keys() == want.keys()
    assert len(set(G.directions(x[::2]).tolist())) < 10 and len(set(G.directions(x[1::2]).tolist())) == 300


def test_copies_ties_unusable_rows_and_redelivery(spark):
    x = clusters(60, 6)
    ids = np.arange(60)
    x[10] = x[4] = x[3]
    rows = [(int(i), "a", [float(v) for v in r]) for i, r in zip(ids, x)]
    rows += [rows[5], (100, "a", None), (101, "a", [0.0] * 64), (102, "a", [1.0] * 32), (103, "a", [float("nan")] + [1.0] * 63), (104, "a", [float("inf")] * 64), (105, "a", [None] + [1.0] * 63), (None, "a", [1.0] * 64), (106, None, [1.0] * 64), (107, "b", [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, dataset string, vec array<float>")
    got = lists(G.neighbours(df))
    want = brute(ids, x, 5)
    assert {i: list(v) for i, v in got.items()}.keys() == want.keys()
    assert all(set(got[i]) == set(want[i]) for i in want)
    assert got[3][4] == 1_000_000 and got[3][10] == 1_000_000
    assert G.neighbours(df.limit(0)).count() == 0


def test_a_vector_that_a_third_of_the_rows_share(spark):
    x = clusters(300, 5)
    x[::3] = x[0]
    ids = np.arange(300)
    got = lists(G.neighbours(frame(spark, ids, x)))
    want = brute(ids, x, 5)
    assert recall(got, want) == 1.0 and got.keys() == want.keys()


def test_neighbours_of_a_hot_vector_in_a_table_of_many_cells(spark, monkeypatch):
    """A third of the rows share one vector, 200 others lie around it: planes must not be drawn
    through the copies."""
    for name, v in (("CELL", 500), ("LEAST", 60), ("ASK", 1500), ("WIDE", 300)):
        monkeypatch.setattr(G, name, v)
    x = clusters(12_000, 20)
    rng = np.random.default_rng(3)
    near = np.arange(1, 600, 3)
    x[near] = x[0] + 0.3 * rng.standard_normal((len(near), 64)).astype(np.float32)
    x[::3] = x[0]
    ids = np.arange(len(x))
    got = G.neighbours(spark.createDataFrame(pa.table({"vec_id": ids, "dataset": ["a"] * len(x), "vec": list(x)})))
    got = lists(got)
    hot = set(range(0, len(x), 3))
    met = [len(hot & set(got.get(int(i), {}))) / 5 for i in near]
    assert np.mean(met) >= 0.95 and got.keys() == set(ids.tolist())


def test_centroids_both_ways(spark, monkeypatch):
    x = clusters(50, 5)
    c = clusters(30, 3, seed=4)
    v = frame(spark, np.arange(50), x)
    cen = spark.createDataFrame([(i, "a", [float(t) for t in r]) for i, r in enumerate(c)] + [(99, "a", None)], "pid int, dataset string, vec array<float>")
    one = lists(G.centroid_neighbours(v, cen))
    monkeypatch.setattr(G, "CENTROID_LIMIT", 12)
    monkeypatch.setattr(G, "ASK", 20)
    two = lists(G.centroid_neighbours(v, cen))
    assert one == two and len(one) == 50
    w, u = x / np.linalg.norm(x, axis=1, keepdims=True), c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.rint(w.astype(float) @ u.T.astype(float) * 1e6)
    assert all(sorted(one[i].values(), reverse=True) == pytest.approx(sorted(s[i], reverse=True)[:5], abs=1) for i in range(50))
