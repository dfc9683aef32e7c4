"""Hand-computed cases and invariants of functions and operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import stats, text, vector
from evigraph.operators import components, contract, fusion, graph, lexical, metrics, partition


def ranking(spark, lists):
    return spark.createDataFrame([(q, i + 1, d, float(len(ds) - i)) for q, ds in lists.items() for i, d in enumerate(ds)], "query_id long, rnk long, doc_id long, score double")


def order(df, q=1):
    return [r.doc_id for r in df.where(F.col("query_id") == q).orderBy("rnk").collect()]


def test_bm25_fills_with_documents_that_share_no_term(spark):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, "alpha gamma"), (2, "delta epsilon"), (3, "beta gamma"), (4, None), (5, " ")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "delta")], "query_id long, text string")
    got = lexical.bm25_filled(q, docs, 6)
    assert order(got, 1)[0] == 0 and set(order(got, 1)) == set(range(6)) and order(got, 1)[-3:] == [2, 4, 5]
    assert order(got, 2)[0] == 2 and order(got, 2)[1:] == [0, 1, 3, 4, 5]


def test_rrf_deduplicates_and_weighs(spark):
    a, b = ranking(spark, {1: [0, 1, 2]}), ranking(spark, {1: [2, 1, 3]})
    got = order(fusion.rrf({"a": a, "b": b}, weights={"a": 1.0, "b": 4.0}))
    assert got[0] == 2 and sorted(got) == [0, 1, 2, 3]


def test_rrf_cut_is_deterministic(spark):
    a, b = ranking(spark, {1: [1, 2, 3], 2: [4, 5, 6]}), ranking(spark, {1: [3, 2, 7], 2: [6, 8, 4]})
    got = fusion.rrf({"a": a, "b": b}, 2)
    assert set(order(got, 1)) == {2, 3} and set(order(got, 2)) == {4, 6}


def test_a_union_of_partitioned_inputs_is_grouped_once(spark):
    lists = {"a": fusion.ranked(ranking(spark, {q: list(range(50)) for q in range(5)}).drop("rnk")), "b": fusion.ranked(ranking(spark, {q: list(range(25, 75)) for q in range(5)}).drop("rnk"))}
    f = fusion.rrf(lists, 100)
    g = spark.createDataFrame([(q, d) for q in range(5) for d in (1, 30, 60)], "query_id long, doc_id long")
    assert [r.golds for r in metrics.per_query(f, g, [100]).collect()] == [3] * 5


def test_full_coverage_needs_every_gold(spark):
    m = metrics.per_query(ranking(spark, {1: [4, 1, 3, 2]}), spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "query_id long, doc_id long"), [2, 5]).first()
    assert (m.full_2, m.full_5, m.recall_2, m.weakest, m.mrr) == (0, 1, 0.5, 4, 0.5)


def test_weakest_rank_counts_a_miss_as_the_sentinel(spark):
    r, g = ranking(spark, {1: [8, 2, 5], 2: [7, 6, 4]}), spark.createDataFrame([(1, 8), (1, 5), (2, 7), (2, 99)], "query_id long, doc_id long")
    assert {x.query_id: x.weakest for x in metrics.per_query(r, g, [3]).collect()} == {1: 3, 2: 4}


def test_metrics_are_monotone(spark):
    rng = random.Random(3)
    lists = {q: rng.sample(range(200), 200) for q in range(12)}
    g = spark.createDataFrame([(q, d) for q in lists for d in rng.sample(range(200), 3)], "query_id long, doc_id long")
    for m in metrics.per_query(ranking(spark, lists), g, [5, 20, 100]).collect():
        assert m.recall_5 <= m.recall_20 <= m.recall_100 and m.full_5 <= m.full_20 <= m.full_100
        assert all(m[f"full_{k}"] <= m[f"recall_{k}"] for k in (5, 20, 100)) and 0 <= m.ndcg_20 <= 1


def test_mcnemar(spark):
    cases = [(0, 0), (5, 5), (20, 2), (2, 20), (6000, 6000), (3, 1)]
    got = spark.createDataFrame(cases, "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c"))).collect()
    p = [r[0] for r in got]
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert p[0] == 1.0 and p[2] == pytest.approx(exact(20, 2), rel=1e-9) and p[2] == p[3] and p[4] == 1.0 and p[5] == pytest.approx(exact(3, 1))


def test_interpolation_clamps(spark):
    pts = spark.createDataFrame([(1.0, 10.0), (10.0, 100.0)], "x double, y double")
    assert {r.x: r.y for r in stats.interpolate(pts, "x", "y", [0.5, 5.0, 20.0]).collect()} == {0.5: 10.0, 5.0: 50.0, 20.0: 100.0}


def test_kappa_is_null_where_agreement_is_expected(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 1), ("y", 1, 0), ("y", 0, 0), ("y", 1, 1)], "k string, a int, b int")
    got = {r.k: r.kappa for r in stats.kappa(df, ["k"], "a", "b").collect()}
    assert got["x"] is None and got["y"] == pytest.approx(0.4)


def test_answers(spark):
    rows = [("1", "The Eiffel Tower!", ["eiffel tower"]), ("2", "Paris, France", ["Paris"]), ("3", "", [""]), ("4", None, ["x"]), ("5", "x", None), ("6", "x", [])]
    got = {r.id: (r.em, r.f1) for r in metrics.answer_scores(spark.createDataFrame(rows, "id string, p string, a array<string>"), "id", "p", "a").collect()}
    assert got["1"] == (1, 1.0) and got["2"] == (0, pytest.approx(2 / 3, abs=1e-6)) and got["3"] == (0, 0.0) and got["4"] == (0, 0.0)
    assert got["5"] == (None, None) and got["6"] == (None, None)


def test_budget_cuts_the_chunk_at_the_boundary(spark):
    c = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 5)], "query_id long, rnk long, tokens long")
    assert [(r.rnk, r.kept) for r in metrics.fit_budget(c, 8).orderBy("rnk").collect()] == [(1, 5), (2, 3)]


def test_hydrate_drops_unknown_ids(spark):
    ext = spark.createDataFrame([("q", ["d2", "missing", "d1", "d2"])], "query_id string, doc_ids array<string>")
    docs = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, title string")
    assert [(r.rnk, r.doc_id, r.context) for r in contract.hydrate(ext, docs, 1).orderBy("rnk").collect()] == [(1, "d2", True), (2, "d1", False)]


def test_topk_ties_nulls_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0])], "doc_id long, vec array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, None)], "query_id long, vec array<float>")
    monkeypatch.setattr(vector, "BLOCK", 1)
    got = vector.topk(q, items, 2, "unit")
    assert order(got, 7) == [1, 2] and order(got, 8) == [3, 1] and order(got, 9) == []
    assert vector.topk(q.limit(0), items, 2).count() == 0 and vector.topk(q, items.limit(0), 2).count() == 0


def test_mean_by_matches_numpy(spark):
    df = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(30)] + [(0, None)], "k long, v array<double>")
    got = {r.k: r.vec for r in vector.mean_by(df, ["k"], "v").collect()}
    x = sum(i for i in range(30) if i % 3 == 1) / 10
    assert got[1] == pytest.approx([x / math.hypot(x, 1), 1 / math.hypot(x, 1)])


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [("hub", f"n{i:03d}") for i in range(0, 60)] + [("x", "x"), (None, "y")]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    sets = {}
    for n in parent:
        sets.setdefault(find(n), set()).add(n)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: min(s) for s in sets.values() for n in s}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shared_entities_cap_hubs(spark):
    p = spark.createDataFrame([(i, "hub") for i in range(30)] + [(1, "e"), (2, "e"), (2, "f"), (1, "f"), (3, "f"), (None, "e"), (4, None)], "doc_id long, entity string")
    got = {(r.src, r.dst): r.w for r in graph.shared_entity(p).collect()}
    assert got[1, 2] == pytest.approx(1 / 2 + 1 / 3) and (5, 6) not in got and got[2, 1] == got[1, 2]


def test_pagerank_loses_the_mass_of_dead_ends(spark):
    p = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, p double")
    s = spark.createDataFrame([("q", "a", 1.0)], "query_id string, node string, w double")
    got = {r.node: r.mass for r in graph.pagerank(s, p, 0.5, 2).collect()}
    assert got == {"a": 0.5, "b": 0.25}


def test_triangles(spark):
    e = graph.mirror(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "d")], "src string, dst string"))
    got = {r.node: (r.degree, r.triangles, r.clustering) for r in graph.triangles(e).collect()}
    assert got == {"a": (2, 1, 1.0), "b": (2, 1, 1.0), "c": (3, 1, pytest.approx(1 / 3, abs=1e-6)), "d": (1, 0, 0.0)}


def test_chunks_are_contiguous(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(25)], "id long")
    got = [r.pid for r in partition.chunks(df, "id", 10).orderBy("id").collect()]
    assert got == [0] * 10 + [1] * 10 + [2] * 5
    assert partition.chunks(df.limit(0), "id", 10).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("<Ann##born in##Rome>$$<x##y>$$<Ann##born in##Rome>$$<a## ##c>", "Who met Ann Bo and Carl [the poet]?", "One. Two? \"Three\" four  Five", "people.person.place_of_birth")], "t string, q string, s string, r string")
    r = df.select(text.triplets(F.col("t")).alias("t"), text.decompose(F.col("q")).alias("q"), text.sentences(F.col("s")).alias("s"), text.relation_label(F.col("r")).alias("r")).first()
    assert [tuple(x) for x in r.t] == [("Ann", "born in", "Rome")]
    assert r.q[0].startswith("Who") and {"the poet", "Ann Bo", "Carl"} <= set(r.q)
    # a double blank anywhere parts the text there and nowhere else
    assert r.s == ['One. Two? "Three" four', "Five"] and r.r == "place of birth"
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(text.sentences, "First one.  Second one.") == ["First one.", "Second one."]
    assert one(text.sentences, 'One. Two? "Three" four\tfive.\nno. 6') == ["One.", "Two?", '"Three" four five. no.', "6"]
    assert one(text.sentences, None) == [] and one(text.sentences, " \r\n ") == []
    assert one(text.decompose, "Are the University of Oxford and The Bank of the South (old) both in England?") == [
        "Are the University of Oxford and The Bank of the South (old) both in England?", "the University of Oxford", "Bank of the South (old)", "England",
    ]
    assert one(text.decompose, "who directed the film [Big  Fish], Film or Al?") == ["who directed the film [Big  Fish], Film or Al?", "Big  Fish"]
    assert one(lambda c: text.content_key(c, c), "ＡＢ  c") == one(lambda c: text.content_key(c, F.lit("AB c")), "ab C") != one(lambda c: text.content_key(c, F.lit("ab c")), "ab C")


def test_paired_comparison_refuses_other_ids(spark):
    a = spark.createDataFrame([("q1", 1.0), ("q2", 0.0)], "pair string, v double")
    b = spark.createDataFrame([("q1", 0.0), ("q3", 0.0)], "pair string, v double")
    with pytest.raises(ValueError, match="identical query IDs"):
        contract.compare(a, b, "v")
    assert contract.compare(a, b, "v", strict=False).first()[:5] == (1, 2, 1, 0, 0)
    assert contract.compare(a, a, "v").first().ties == 2
    x = spark.createDataFrame([("q1", "Q", ["A"]), ("q2", "Q", None)], "id string, question string, answers array<string>")
    y = spark.createDataFrame([("q1", "Q", ["B"]), ("q3", "Q", None)], "id string, question string, answers array<string>")
    assert {tuple(r) for r in contract.differing(x, y).collect()} == {("q1", "answers differs"), ("q2", "only in the first"), ("q3", "only in the second")}


def test_connected_sets_settle_on_long_paths(spark):
    n = 700
    e = graph.mirror(spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)], "src string, dst string"))
    m = spark.createDataFrame([("q", f"n{i:04d}") for i in range(n + 1)] + [("r", f"n{i:04d}") for i in range(n + 1) if i != 350], "query_id string, doc_id string")
    g = spark.createDataFrame([(q, d) for q in "qr" for d in ("n0000", f"n{n:04d}")], "query_id string, doc_id string")
    assert {r.query_id: (r.covered, r.connected) for r in graph.connected_sets(m, e, g).collect()} == {"q": (True, True), "r": (True, False)}


def test_ranks_by_counting_equal_the_whole_ranking(spark):
    import numpy as np

    from evigraph.functions import vector

    rng = np.random.default_rng(0)
    x = rng.integers(-1, 2, (60, 4)) + 0.5  # many ties
    it = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    q = it.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    every = {(r.query_id, r.doc_id): r.rnk for r in vector.topk(q, it, 100, "unit", exclude_self=True).collect()}
    pairs = spark.createDataFrame([k for k in every], "query_id long, doc_id long")
    assert {(r.query_id, r.doc_id): r.rnk for r in vector.rank_of(q, it, pairs).collect()} == every


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    from evigraph.functions import vector

    it = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(80)], "doc_id long, vec array<double>")
    q = it.withColumnRenamed("doc_id", "query_id")
    one = sorted(map(tuple, vector.topk(q, it, 3, "unit", exclude_self=True).collect()))
    monkeypatch.setattr(vector, "BLOCK", 30)
    assert sorted(map(tuple, vector.topk(q, it, 3, "unit", exclude_self=True).collect())) == one


def test_partitions_in_blocks_give_the_same(spark, monkeypatch):
    it = spark.createDataFrame([(i, i % 3 if i % 2 else 0, [float(i % 7), float(i % 5), 1.0]) for i in range(90)], "doc_id long, pid long, vec array<double>")
    q = it.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query_id"), "vec")
    routed = q.select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pid"))
    one = sorted(map(tuple, partition.scoped(q, routed, it, 5).collect()))
    more = it.unionByName(spark.createDataFrame([(900, 0, None), (901, None, [1.0, 1.0, 1.0])], it.schema))
    assert sorted(map(tuple, partition.scoped(q, routed, more, 5).collect())) == one
    monkeypatch.setattr(partition, "ROWS", 10)
    monkeypatch.setattr(partition, "ASKING", 4)
    assert one and sorted(map(tuple, partition.scoped(q, routed, it, 5).collect())) == one


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(str(i), "s", float(i % 2)) for i in range(400)], "id string, system string, em double")
    r = contract.bootstrap(df, ["system"], "em").first()
    assert 0.4 < r.low < 0.5 < r.high < 0.6


def test_sign_flip_tells_a_shift_from_none(spark):
    shift = spark.createDataFrame([(i, 1.0 + (i % 3)) for i in range(40)], "id long, d double")
    none = spark.createDataFrame([(i, float(1 - 2 * (i % 2))) for i in range(40)], "id long, d double")
    assert contract.sign_flip(shift, "d").first().p < 0.01 and contract.sign_flip(none, "d").first().p == 1.0


def test_groups_in_ranges_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(0, 9)) for k in rng.sample(range(-500, 5000), 300)]
    want, seen = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        idx, prev, upto = seen.get(g, (0, None, 0))
        want[k] = (idx, prev, upto + v)
        seen[g] = (idx + 1, k, upto + v)
    df = spark.createDataFrame(rows + [("a", None, 1)], "g string, k long, v long")
    for ranges in (1, 7, 4096):
        monkeypatch.setattr(partition, "RANGES", ranges)
        assert {r.k: (r.idx, r.prev, r.upto) for r in partition.in_groups(df, "g", "k", "v").collect()} == want
    assert "upto" not in partition.in_groups(df.limit(0), "g", "k").columns


def test_subcentroids_find_the_blobs_of_each_partition(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows, centres = [], {}
    for p in range(3):
        for b in range(2):
            c = rng.standard_normal(5) * 10
            centres.setdefault(p, []).append(c)
            rows += [(len(rows) + i, p, [float(x) for x in c + 0.1 * rng.standard_normal(5)]) for i in range(30)]
    rows.append((9999, 7, [1.0] * 5))
    it = spark.createDataFrame(rows, "doc_id long, pid long, vec array<double>")
    got = {}
    for r in partition.subcentroids(it, 2).collect():
        got.setdefault(r.pid, []).append(np.array(r.vec))
    assert all(min(np.linalg.norm(c - m) for m in got[p]) < 0.2 for p in centres for c in centres[p]) and len(got[7]) == 1
    one = {r.pid: r.vec for r in partition.subcentroids(it, 1).collect()}
    assert np.allclose(one[0], np.mean([v for _, p, v in rows if p == 0], axis=0))


def test_partitions_follow_the_graph(spark):
    """Two cliques with ids mixed up: cut along the graph they stay whole, cut by id they don't."""
    ids = {c: [2 * i + c for i in range(20)] for c in (0, 1)}
    e = [(a, b) for c in ids for a in ids[c] for b in ids[c] if a != b] + [(0, 1), (1, 0)]
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    edges = spark.createDataFrame(e, "src long, dst long")
    got = {r.node: r.pid for r in partition.balanced(partition.spread_labels(nodes, edges, 3), 20).collect()}
    assert len({got[i] for i in ids[0]}) == 1 and len({got[i] for i in ids[1]}) == 1 and len(set(got.values())) == 2
