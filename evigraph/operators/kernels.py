"""Kernels that are sequential per query: greedy, heap-ordered or shortest-path, each run in Arrow or
pandas groups by query over a neighbourhood that joins have bounded before.

Every kernel takes one query's nodes and edges as plain arrays, so that it can be tested against a
brute-force version without Spark."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Adjacency = dict[str, list[str]]


def dijkstra(adj: dict[str, list[tuple[str, float]]], sources: list[str]) -> dict[str, float]:
    """Least cost from any source."""
    dist = {s: 0.0 for s in sources}
    heap = [(0.0, s) for s in sorted(sources)]
    while heap:
        d, x = heapq.heappop(heap)
        if d > dist[x]:
            continue
        for y, c in adj.get(x, []):
            if d + c < dist.get(y, float("inf")):
                dist[y] = d + c
                heapq.heappush(heap, (d + c, y))
    return dist


def bridge(nodes: list[str], rel: dict[str, float], adj: dict[str, list[str]], sim, seeds: list[str], anchors: list[str], missing: float = 9.9) -> dict[str, float]:
    """Bidirectional bridge scores: half the scaled relevance, half 1 / (1 + cost from the seeds +
    cost from the anchors); an edge costs max(1 - sim of its two ends, 1e-4), and paths stay among
    ``nodes``."""
    inside = set(nodes)
    cost = {x: [(y, max(1.0 - sim(x, y), 1e-4)) for y in adj.get(x, []) if y in inside] for x in nodes}
    a, b = dijkstra(cost, [s for s in seeds if s in inside]), dijkstra(cost, anchors)
    lo, hi = min(rel[n] for n in nodes), max(rel[n] for n in nodes)
    return {n: 0.5 * ((rel[n] - lo) / (hi - lo) if hi > lo else 0.0) + 0.5 / (1.0 + a.get(n, missing) + b.get(n, missing)) for n in nodes}


def cover_greedy(ids: list, rel: np.ndarray, vecs: np.ndarray, k: int, gamma: float = 0.35, stop: float = 0.02) -> list:
    """Relevance less gamma times the largest similarity to what is chosen; stops when the gain falls
    under ``stop`` of the first. Ties go to the earlier id."""
    sim = vecs @ vecs.T
    best, chosen, first = np.zeros(len(ids)), [], None
    free = np.ones(len(ids), bool)
    while len(chosen) < min(k, len(ids)):
        gain = np.where(free, rel - gamma * np.maximum(best, 0.0), -np.inf)
        i = int(np.argmax(np.round(gain, 9)))
        first = gain[i] if first is None else first
        if chosen and gain[i] < stop * first:
            break
        chosen.append(i)
        free[i] = False
        best = np.maximum(best, sim[i])
    return [ids[i] for i in chosen]


def spread_greedy(ids: list[str], mass: dict[str, float], adj: Adjacency, k: int, penalty: float = 0.5) -> list[str]:
    """PageRank mass, scaled by its largest, less a penalty for every chosen neighbour; ties go to the
    smaller id."""
    most = max((mass[n] for n in ids), default=0.0) or 1.0
    score = {n: mass[n] / most for n in ids}
    heap = [(-round(score[n], 9), n) for n in sorted(ids)]
    heapq.heapify(heap)
    out: list[str] = []
    while heap and len(out) < k:
        s, x = heapq.heappop(heap)
        if x not in score or -s > round(score[x], 9):
            continue  # it was penalised since
        out.append(x)
        del score[x]
        for y in adj.get(x, []):
            if y in score:
                score[y] -= penalty
                heapq.heappush(heap, (-round(score[y], 9), y))
    return out


def best_first(
    adj: Adjacency, rel: dict[str, float], seeds: list[str], budget: int = 200, alpha: float = 0.5, window: int = 15, floor: float = 0.15, explore: int = 25,
    covers: dict[str, list[str]] | None = None, entities: set[str] | frozenset[str] = frozenset(), reader=None,
) -> list[tuple[str, int, str | None, float, str]]:
    """Bounded best-first search: ``(node, depth, parent, priority, stop)`` in order of expansion.

    A seed's priority is its relevance, 1e-3 at least; a child's is alpha times that of the node it is
    reached from plus (1 - alpha) times its own relevance, floored at 0. Parent and depth are those of
    the first discovery. The search isn't cut short: ``stop`` names, on the row where each first
    holds, once ``explore`` nodes are expanded, why it may end: ``entity_coverage``, every one of
    ``entities`` is in ``covers`` of an expanded node that is no seed; ``anchor_meet``, the lineages of
    two seeds met in a node that is no seed; ``marginal_saturation``, a full window of ``window`` nodes
    has no relevance of ``floor``; ``reader_sufficiency``, ``reader(order)`` says so; ``budget``, on
    the last row of a full budget of a search without another reason."""
    start = set(seeds)
    heap = [(-max(rel.get(s, 0.0), 1e-3), s) for s in seeds]
    heapq.heapify(heap)
    parent: dict[str, str | None] = {s: None for s in seeds}
    line: dict[str, int] = {s: i for i, s in enumerate(seeds)}
    depth = dict.fromkeys(seeds, 0)
    out: list[tuple[str, int, str | None, float, str]] = []
    seen: set[str] = set()
    order: list[str] = []
    last: list[float] = []
    covered: set[str] = set()
    meet, fired = False, set()
    while heap and len(out) < budget:
        p, x = heapq.heappop(heap)
        if x in seen:
            continue
        seen.add(x)
        order.append(x)
        if x not in start:
            covered.update(e for e in (covers or {}).get(x, []) if e in entities)
        last = (last + [rel.get(x, 0.0)])[-window:]
        why = []
        if len(order) >= explore:
            why = [
                name for name, holds in (
                    ("entity_coverage", bool(entities) and entities <= covered),
                    ("anchor_meet", meet),
                    ("marginal_saturation", len(last) == window and max(last) < floor),
                    ("reader_sufficiency", reader is not None and "reader_sufficiency" not in fired and reader(order)),
                ) if holds and name not in fired
            ]
            fired.update(why)
        if not fired and len(order) == budget:
            why = ["budget"]
        out.append((x, depth[x], parent[x], -p, "+".join(why)))
        for y in sorted(adj.get(x, [])):
            if y in seen:
                continue
            heapq.heappush(heap, (-(alpha * -p + (1 - alpha) * max(rel.get(y, 0.0), 0.0)), y))
            if y not in parent:
                parent[y], line[y], depth[y] = x, line[x], depth[x] + 1
            elif y not in start and line[y] != line[x]:
                meet = True
    return out


def path_to(parents: dict[str, str | None], node: str) -> list[str]:
    """From the seed to a node, by parents."""
    out = [node]
    while parents.get(out[-1]) is not None:
        out.append(parents[out[-1]])
    return out[::-1]


def min_cover(choices: list[set[int]], budget: int) -> tuple[bool, list[int]]:
    """Greedy cover of golds, each by any of its partitions, with at most ``budget`` partitions; ties
    go to the smaller partition."""
    open_, picked = [c for c in choices], []
    while open_ and len(picked) < budget:
        count: dict[int, int] = defaultdict(int)
        for c in open_:
            for p in c:
                count[p] += 1
        if not count:
            break
        p = min(count, key=lambda x: (-count[x], x))
        picked.append(p)
        open_ = [c for c in open_ if p not in c]
    return not open_, picked


def soar(x: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """m partitions of each row: the nearest centroid, then each time the one nearest to the residual
    after the chosen centroids' directions are taken out (Gram-Schmidt), all rows at once."""
    r = x.astype(float).copy()
    rows = np.arange(len(x))
    out = np.empty((len(x), m), np.int64)
    basis: list[np.ndarray] = []
    for j in range(m):
        s = np.round(r @ centroids.T, 9)
        s[rows[:, None], out[:, :j]] = -np.inf
        out[:, j] = s.argmax(axis=1)
        b = centroids[out[:, j]].astype(float).copy()
        for e in basis:
            b -= np.einsum("ij,ij->i", b, e)[:, None] * e
        n = np.sqrt(np.einsum("ij,ij->i", b, b))[:, None]
        b = np.where(n > 1e-12, b / np.maximum(n, 1e-12), 0.0)
        basis.append(b)
        r -= np.einsum("ij,ij->i", r, b)[:, None] * b
    return out


def kmeans(x: np.ndarray, c: int, rounds: int = 10) -> np.ndarray:
    """Sub-centroids: the members if there are at most c, the mean for c = 1, else Lloyd's from
    evenly spaced members of a fixed order."""
    x = x[np.lexsort(x.T[::-1])]
    if len(x) <= c:
        return x
    if c == 1:
        return x.mean(axis=0, keepdims=True)
    means = x[np.linspace(0, len(x) - 1, c).astype(int)].copy()
    for _ in range(rounds):
        near = ((x[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([x[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(c)])
    return means


class Agent:
    """Think-act-observe traversal of one query over a bounded graph, with partition gates. Its
    numbers are fixed values."""

    STEPS, BEAM, PUSH, SELECT, ADMIT, DYNAMIC, SLICE, LEAST, MOST = 20, 50, 8, 0.30, 0.35, 3, 5, 3, 10

    def __init__(self, cos: dict[str, float], sim, pid: dict[str, int], cen: dict[int, float], adj: Adjacency, expand: bool = True, threshold: float = 0.4) -> None:
        self.cos, self.sim, self.pid, self.cen, self.adj = cos, sim, pid, cen, adj
        self.expand, self.threshold = expand, threshold

    def score(self, n: str, l2: float, depth: int, parent: str | None, chosen: list[str]) -> float:
        p = self.pid.get(n, -1)
        near = max((self.sim(n, c) for c in chosen[:10]), default=0.0)
        return (
            self.cos.get(n, 0.0) + 0.25 * l2 + 0.15 * self.cen.get(p, 0.0) + (0.10 * self.sim(parent, n) if parent else 0.0)
            - 0.10 * near - 0.03 * depth - 0.04 * sum(self.pid.get(c, -1) == p for c in chosen)
        )

    def run(self, seeds: list[tuple[str, float]]) -> list[tuple[int, str, int, str | None, float, str]]:
        """``(step, node, depth, parent, score, action)`` of every decision; the context follows with
        the action ``context``."""
        lo, hi = min(s for _, s in seeds), max(s for _, s in seeds)
        scaled = [(n, (s - lo) / (hi - lo) if hi > lo else 1.0) for n, s in seeds]
        admitted = {self.pid.get(n, -1) for n, _ in scaled}
        heap, count, popped, steps, dynamic = [], 0, set(), 0, 0
        chosen: list[str] = []
        kept: dict[str, float] = {}
        trace: list[tuple[int, str, int, str | None, float, str]] = []
        for n, s in scaled:
            heapq.heappush(heap, (-self.score(n, s, 0, None, []), count, n, s, 0, None))
            count += 1
        while heap and steps < self.STEPS:
            _, _, n, l2, depth, parent = heapq.heappop(heap)
            if n in popped:
                continue
            popped.add(n)
            steps += 1
            p = self.pid.get(n, -1)
            if p not in admitted:
                gate = 0.5 * self.cos.get(n, 0.0) + 0.35 * self.cen.get(p, 0.0) + (0.15 * self.sim(parent, n) if parent else 0.0) - 0.03 * depth
                if not (self.expand and dynamic < self.DYNAMIC and gate >= self.ADMIT):
                    trace.append((steps, n, depth, parent, gate, "rejected"))
                    continue
                admitted.add(p)
                dynamic += 1
                trace.append((steps, n, depth, parent, gate, "admitted"))
                own = sorted((m for m in self.pid if self.pid[m] == p and m not in popped), key=lambda m: (-self.cos.get(m, 0.0), m))
                for m in own[: self.SLICE]:
                    heapq.heappush(heap, (-self.score(m, 0.0, depth + 1, n, chosen), count, m, 0.0, depth + 1, n))
                    count += 1
            s = self.score(n, l2, depth, parent, chosen)
            if s < self.SELECT:
                trace.append((steps, n, depth, parent, s, "pruned"))
                continue
            chosen.append(n)
            kept[n] = s
            trace.append((steps, n, depth, parent, s, "selected"))
            if s >= self.threshold:
                near = [(self.score(m, 0.0, depth + 1, n, chosen), m) for m in sorted(self.adj.get(n, [])) if m not in popped]
                for v, m in sorted(near, key=lambda t: (-t[0], t[1]))[: self.PUSH]:
                    heapq.heappush(heap, (-v, count, m, 0.0, depth + 1, n))
                    count += 1
            if len(heap) > self.BEAM:
                heap = heapq.nsmallest(self.BEAM, heap)
                heapq.heapify(heap)
        for n, s in sorted(scaled, key=lambda t: (-t[1], t[0])):
            if len(chosen) >= self.LEAST:
                break
            if n not in kept:
                chosen.append(n)
                kept[n] = s
                trace.append((steps, n, 0, None, s, "filled"))
        context: list[str] = []
        while len(context) < min(self.MOST, len(chosen)):
            rest = [n for n in chosen if n not in context]
            value = lambda n: kept[n] - 0.10 * max((self.sim(n, c) for c in context), default=0.0) - 0.04 * sum(self.pid.get(c, -1) == self.pid.get(n, -1) for c in context)  # noqa: B023, E731
            x = max(rest, key=lambda n: (round(value(n), 9), [-ord(c) for c in n]))
            trace.append((steps, x, 0, None, value(x), "context"))
            context.append(x)
        return trace


def neighbourhoods(seeds: DataFrame, edges: DataFrame, hops: int, cap: int = 2500) -> DataFrame:
    """``(query_id, node, hop, mass, out ARRAY)``: each query's ball, cut by PageRank mass, with all
    neighbours inside it, the bounded input of the kernels."""
    from evigraph.operators.graph import ball as bounded
    from evigraph.session import cut

    e = cut(edges)
    ball = cut(bounded(seeds, e, hops, cap))
    inner = ball.select("query_id", F.col("node").alias("src")).join(e, "src").join(ball.select("query_id", F.col("node").alias("dst")), ["query_id", "dst"], "left_semi")
    out = inner.groupBy("query_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("out"))  # at most the ball
    return ball.join(out, ["query_id", "node"], "left")


def per_query(df: DataFrame, kernel, schema: str) -> DataFrame:
    """Runs ``kernel(pdf) -> rows`` on each query's bounded group."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(kernel(pdf.sort_values("node").reset_index(drop=True)), columns=names)

    return df.groupBy("query_id").applyInPandas(run, schema)
