"""Traversals around a hub against brute force: no neighbour is lost to a cap."""

import pytest

from evigraph.operators import graph, kernels
from evigraph.plans import nodes as N
from evigraph.plans import traversal as T

HUB = 3000
LEAVES = [f"n{i:04d}" for i in range(HUB)]
TAIL = [f"z{i}" for i in range(6)]


@pytest.fixture
def world(spark, monkeypatch):
    """A question whose gold is a hub; the last leaf leads into a chain of titles like the question."""
    rows = [("q100", "question", "s", None, "amber bell tower", ["hub1"]), ("hub1", "doc", "s", "amber", "", LEAVES)]
    rows += [(x, "doc", "s", "bell tower amber" if x == LEAVES[-1] else "other", "", [TAIL[0]] if x == LEAVES[-1] else []) for x in LEAVES]
    rows += [(x, "doc", "s", "amber bell", "", [y] if y else []) for x, y in zip(TAIL, [*TAIL[1:], None])]
    df = spark.createDataFrame(rows, "node_id string, type string, source string, title string, content string, neighbors array<string>").cache()
    monkeypatch.setattr(N, "nodes", lambda spark, sf, *c: df.select("node_id", *c))
    return spark


def test_best_first_walks_on_at_any_depth_and_past_64_neighbours(world):
    got = {r.node: r.depth for r in T.best_first(world, "").collect()}
    assert len(got) == 200 and got[LEAVES[-1]] == 1 and [got[x] for x in TAIL] == [2, 3, 4, 5, 6, 7]


def test_random_walks_choose_among_all_neighbours(world):
    rows = T.random_walks(world, "").where("step = 1").collect()
    pick = world.createDataFrame([(x,) for x in LEAVES], "x string").selectExpr("x", "md5(concat('13:1:q100:', x)) as h").orderBy("h").first().x
    assert pick > LEAVES[63] and [r.node for r in rows] == [pick]


def test_balls_keep_2500_and_the_seeds(world):
    ball = {r.node: r.hop for r in T.N.ppr_ball_2500(world, "").collect()}
    assert ball["hub1"] == 0 and len(ball) == 2500
    small = graph.ball(N.seeds(world, ""), N.edges(world, ""), 2, 0).collect()
    assert [r.node for r in small] == ["hub1"]
    out = {r.node: r.out for r in kernels.neighbourhoods(N.seeds(world, ""), N.edges(world, ""), 2).collect()}
    assert len(out["hub1"]) >= 2498 and LEAVES[-1] in out["hub1"]
    assert sum(r.hop == 1 for r in N.reach_capped_64(world, "").collect()) == 64


def test_coverage_picks_the_largest_budget(world):
    assert T.cover_graph(world, "").count() == 200


def planted(spark, monkeypatch):
    """Four kinds of steps between vectors, one a label, each along a chain of a hundred."""
    import numpy as np

    from evigraph.plans import retrieval as R

    rng = np.random.default_rng(3)
    steps = rng.standard_normal((4, 16)) * 3
    rows = []
    for label in range(4):
        at = rng.standard_normal(16) * 40
        for i in range(100):
            rows.append((label * 100 + i, label, [float(x) for x in at]))
            at = at + steps[label] + 0.01 * rng.standard_normal(16)
    df = spark.createDataFrame(rows, "doc_id long, pid long, vec array<double>").cache()
    monkeypatch.setattr(R, "items", lambda spark, sf: df)
    return spark


def test_relation_offsets_recover_planted_steps(spark, monkeypatch):
    s = planted(spark, monkeypatch)
    monkeypatch.setattr(T, "unit", lambda c: c)
    got = {r.relation: r.edges for r in T.relation_offsets(s, "").collect()}
    assert sorted(got.values()) == [99, 99, 99, 99]


def test_learned_gate_ranks_queries_that_it_was_not_fitted_on(spark, monkeypatch):
    s = planted(spark, monkeypatch)
    rows = T.learned_gate(s, "").collect()
    half = {r.query_id: r.h for r in s.createDataFrame([(r.query_id,) for r in rows], "query_id long").distinct().selectExpr("query_id", "pmod(xxhash64(query_id), 2) as h").collect()}
    assert rows and set(half.values()) == {1} and all(0 <= r.score <= 1 for r in rows)
