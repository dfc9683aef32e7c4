"""Sequential kernels against brute force on small graphs."""

import itertools
import random

import numpy as np
import pytest

from evigraph.operators import kernels as K


def small_graph(seed, n=14, m=24):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    adj = {x: [] for x in nodes}
    for _ in range(m):
        a, b = rng.sample(nodes, 2)
        if b not in adj[a]:
            adj[a].append(b)
            adj[b].append(a)
    return nodes, adj, {x: rng.random() for x in nodes}


@pytest.mark.parametrize("seed", range(5))
def test_dijkstra_equals_bellman_ford(seed):
    nodes, adj, rel = small_graph(seed)
    cost = {x: [(y, 1 - rel[y]) for y in ys] for x, ys in adj.items()}
    want = {nodes[0]: 0.0, nodes[1]: 0.0}
    for _ in nodes:
        for x, ys in cost.items():
            for y, c in ys:
                if x in want:
                    want[y] = min(want.get(y, 9e9), want[x] + c)
    got = K.dijkstra(cost, nodes[:2])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("seed", range(5))
def test_best_first_expands_the_best_open_node(seed):
    nodes, adj, rel = small_graph(seed)
    out = K.best_first(adj, rel, nodes[:2], budget=10, explore=99)
    prio = {s: max(rel[s], 1e-3) for s in nodes[:2]}
    seen = set()
    for x, _, parent, p, _ in out:
        assert p == pytest.approx(max(v for n, v in prio.items() if n not in seen))
        assert parent is None or parent in seen
        seen.add(x)
        for y in adj[x]:
            prio[y] = max(prio.get(y, 0), 0.5 * p + 0.5 * rel[y])
    assert len(out) == len(seen) <= 10


def test_best_first_names_each_reason_once():
    adj = {"a": ["c", "x"], "b": ["c"], "c": ["a", "b", "d"], "d": ["c"], "x": ["a"]}
    rel = {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.01, "x": 0.02}
    out = K.best_first(adj, rel, ["a", "b"], explore=1, window=2, floor=0.1, covers={"c": ["e1"], "d": ["e2"], "a": ["e2"]}, entities={"e1", "e2"}, reader=lambda order: len(order) == 3)
    assert [x for x, *_ in out] == ["a", "b", "c", "x", "d"]
    stops = {x: s for x, _, _, _, s in out}
    # c is found from a, then from b: the lines meet; a seed's own entity doesn't count
    assert stops["c"] == "anchor_meet+reader_sufficiency" and stops["d"] == "entity_coverage+marginal_saturation" and not stops["a"]
    parents = {x: p for x, _, p, _, _ in out}
    assert K.path_to(parents, "d") == ["a", "c", "d"] and {x: d for x, d, *_ in out}["d"] == 2
    # the largest of a full window, not its mean
    high = K.best_first({"a": ["b"], "b": ["c"], "c": []}, {"a": 0.2, "b": 0.0, "c": 0.0}, ["a"], explore=1, window=2, floor=0.15)
    assert [s for *_, s in high] == ["", "", "marginal_saturation"]
    assert K.best_first(adj, rel, ["a"], budget=2)[-1][4] == "budget"


@pytest.mark.parametrize("seed", range(5))
def test_bridge_equals_all_paths(seed):
    nodes, adj, rel = small_graph(seed, 7, 9)
    rng = random.Random(seed)
    sims = {frozenset(p): rng.random() for p in itertools.combinations(nodes, 2)}
    sim = lambda a, b: sims[frozenset((a, b))]

    def cost(sources, target):
        best = 0.0 if target in sources else 9.9
        for n in range(2, 8):
            for path in itertools.permutations(nodes, n):
                if path[0] in sources and path[-1] == target and all(b in adj[a] for a, b in zip(path, path[1:])):
                    best = min(best, sum(max(1 - sim(a, b), 1e-4) for a, b in zip(path, path[1:])))
        return best

    seeds, anchors = nodes[:1], nodes[-2:]
    got = K.bridge(nodes, rel, adj, sim, seeds, anchors)
    lo, hi = min(rel.values()), max(rel.values())
    for x in nodes:
        want = 0.5 * (rel[x] - lo) / (hi - lo) + 0.5 / (1 + cost(seeds, x) + cost(anchors, x))
        assert got[x] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_spread_greedy_equals_scoring_all_anew(seed):
    nodes, adj, mass = small_graph(seed)
    out, left = [], sorted(nodes)
    most = max(mass.values())
    while left and len(out) < 9:
        x = min(left, key=lambda n: (-round(mass[n] / most - 0.5 * sum(n in adj[c] for c in out), 9), n))
        left.remove(x)
        out.append(x)
    assert K.spread_greedy(nodes, mass, adj, 9) == out


def test_soar_equals_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x, c = rng.standard_normal((40, 6)), rng.standard_normal((9, 6))
    got = K.soar(x, c, 3)
    for i, v in enumerate(x):
        r, basis, taken = v.copy(), [], []
        for j in range(3):
            s = np.round(c @ r, 9)
            s[taken] = -np.inf
            taken.append(int(s.argmax()))
            b = c[taken[-1]].copy()
            for e in basis:
                b -= (b @ e) * e
            basis.append(b / np.linalg.norm(b))
            r = r - (r @ basis[-1]) * basis[-1]
        assert got[i].tolist() == taken


def test_min_cover_finds_a_cover_where_one_partition_is_enough():
    assert K.min_cover([{1, 2}, {2, 3}, {2}], 1) == (True, [2])
    assert K.min_cover([{1}, {2}, {3}], 2)[0] is False
    rng = random.Random(0)
    for _ in range(50):
        sets = [set(rng.sample(range(6), rng.randint(1, 3))) for _ in range(4)]
        ok, picked = K.min_cover(sets, 3)
        best = any(all(s & set(c) for s in sets) for c in itertools.combinations(range(6), 3))
        assert not ok or (best and all(s & set(picked) for s in sets))


def test_cover_greedy_avoids_repeats():
    v = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert K.cover_greedy([1, 2, 3], np.array([1.0, 0.99, 0.8]), v, 3, gamma=0.5, stop=0.0) == [1, 3, 2]


def test_soar_takes_the_residual_second():
    c = np.array([[1.0, 0, 0], [0.9, 0.1, 0], [0, 1.0, 0]])
    assert K.soar(np.array([[1.0, 0.4, 0]]), c, 2).tolist() == [[0, 2]] or K.soar(np.array([[1.0, 0.4, 0]]), c, 2)[0, 1] != 0


def test_kmeans_cases():
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    assert sorted(K.kmeans(x, 2).ravel().round(2)) == [0.05, 5.05]
    assert len(K.kmeans(x, 9)) == 4 and K.kmeans(x, 1)[0, 0] == pytest.approx(2.55)


def test_agent_admits_rejects_and_fills():
    cos = {"a": 0.9, "b": 0.8, "c": 0.05, "d": 0.7}
    pid = {"a": 0, "b": 1, "c": 2, "d": 0}
    a = K.Agent(cos, lambda x, y: 0.0, pid, {0: 0.5, 1: 0.5, 2: 0.0}, {"a": ["b", "c", "d"]})
    t = a.run([("a", 1.0)])
    acts = {(n, w) for _, n, _, _, _, w in t}
    assert ("a", "selected") in acts and ("b", "admitted") in acts and ("b", "selected") in acts and ("c", "rejected") in acts
    assert [n for _, n, _, _, _, w in t if w == "context"][0] == "a"
    assert len({n for n, w in acts if w == "selected"}) <= 20
