import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import packing as P
from evigraph.llm import tokens

needs = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no vocabularies here")


def test_hilbert_visits_every_cell_by_single_steps():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = P.hilbert(g, 3)
    walk = g[np.argsort(k)]
    assert sorted(k.tolist()) == list(range(512)) and set(np.abs(np.diff(walk, axis=0)).sum(axis=1)) == {1}


@pytest.mark.parametrize("seed", range(5))
def test_fill_is_a_packing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 300, 400).tolist()
    out, n = P.fill(sizes, 100)
    room = np.zeros(n, int)
    got = {}
    for i, piece, start, box in out:
        t = min(100, sizes[i] - start)
        room[box] += t
        got.setdefault(i, []).append((piece, start, t))
    assert room.max() <= 100 and n <= sum(sizes) / 100 * 1.05 + 1
    for i, size in enumerate(sizes):
        assert sum(t for _, _, t in got.get(i, [])) == size and (size > 100 or len(got.get(i, [])) == (size > 0))


def test_containers_hold_neighbours_of_the_curve():
    """Packing the largest first, best fit, fills as well but scatters neighbours."""
    rng = np.random.default_rng(1)
    sizes = np.minimum(900, rng.lognormal(4, 0.8, 4000)).astype(int).tolist()

    def spread(rows):
        ends = {}
        for i, box in rows:
            lo, hi = ends.get(box, (i, i))
            ends[box] = min(lo, i), max(hi, i)
        return np.mean([hi - lo for lo, hi in ends.values()])

    out, n = P.fill(sizes, 1000)
    rooms, largest_first = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        box = min((b for b, room in enumerate(rooms) if room >= sizes[i]), key=lambda b: rooms[b], default=len(rooms))
        if box == len(rooms):
            rooms.append(1000)
        rooms[box] -= sizes[i]
        largest_first.append((i, box))
    assert sum(sizes) / (n * 1000) > 0.98 and n <= 1.01 * len(rooms)
    assert spread((i, box) for i, _, _, box in out) < 0.05 * spread(largest_first)


@needs
def test_pack_covers_every_text_once(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 40)
    rows = [(i, None if i == 0 else "" if i == 1 else f"word{i % 5} tail " * (i % 40 + 1) if i % 3 else "same text here", "clash") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    budgets = spark.createDataFrame([(1, "byte_bpe_50k", 32), (2, "piece_bpe_32k", 64), (3, "byte_bpe_50k", 0)], "budget_id int, tokenizer string, capacity long")
    got = P.pack(docs, budgets).cache()
    assert got.groupBy("budget_id", "block", "context").agg(F.sum("tokens").alias("t")).join(budgets, "budget_id").where("t > capacity").count() == 0
    for b, name, cap in ((1, "byte_bpe_50k", 32), (2, "piece_bpe_32k", 64)):
        want = {r.doc_id: len(r.ids) for r in tokens.encode(docs, tokenizer=name).collect() if r.ids}
        own = got.where(F.col("budget_id") == b)
        have = {r.doc_id: (r.t, r.n) for r in own.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
        assert {i: t for i, (t, _) in have.items()} == want and all(n == 1 for i, (_, n) in have.items() if want[i] <= cap)
    assert {(r.budget_id, r.over, r.torn, r.gaps) for r in P.audit(got, budgets).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
    assert {r.budget_id for r in P.fullness(got, budgets).collect()} == {1, 2}
    assert P.pack(docs.limit(0), budgets).count() == 0 and P.pack(docs, budgets.limit(0)).count() == 0
