"""Queries of the sequential kernels. They have no SQL; tests hold them against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.vector import topk, unit
from evigraph.operators import fusion, graph, kernels, partition
from evigraph.plans import nodes as N
from evigraph.plans import retrieval as R
from evigraph.plans.registry import query
from evigraph.session import cut
from evigraph.sources.tables import table


ANCHORS = 12  # nodes of the highest relevance from which a bridge is sought
PICKS = 200  # the largest budget of a coverage
BUDGET = 200  # nodes that a best-first search expands


def _nodes(spark, sf) -> DataFrame:
    """Nodes with their title's words and lower-case content, written once for the rounds of a search."""
    from evigraph.functions.text import alnum

    n = N.nodes(spark, sf, "title", "content", "source")
    return n.select("node_id", "content", "source", F.array_distinct(alnum(F.col("title"))).alias("tw"), F.lower(F.coalesce("content", F.lit(""))).alias("low"))


def _relevance(spark, sf, pairs: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the share of question words that a node's title has, a stand-in for a dense
    score, the title's words, the node's source, the entities that the question names and those of
    them that the node's content has."""
    from evigraph.functions.text import alnum, decompose

    n = _nodes(spark, sf) if n is None else n
    named = F.transform(F.slice(decompose(F.coalesce("content", F.lit(""))), 2, 1 << 30), F.lower)
    asked = n.join(pairs.select(F.col("query_id").alias("node_id")).distinct(), "node_id", "left_semi")
    q = asked.select(F.col("node_id").alias("query_id"), F.array_distinct(alnum(F.col("content"))).alias("qw"), named.alias("entities"))
    d = n.select(F.col("node_id").alias("node"), "tw", "source", "low")
    rel = F.when(F.size("tw") > 0, F.size(F.array_intersect("qw", "tw")) / F.size("tw")).otherwise(0.0)
    both = pairs.join(q, "query_id").join(d, "node").withColumn("rel", F.round(rel, 6))
    return both.withColumn("covers", F.filter("entities", lambda e: F.col("low").contains(e))).drop("qw", "low")


def _balls(spark, sf) -> DataFrame:
    """Two-hop neighbourhoods of the traversals' questions with relevance."""
    ball = kernels.neighbourhoods(N.seeds(spark, sf), N.edges(spark, sf), 2)
    return _relevance(spark, sf, ball).select("query_id", "node", "hop", "mass", "out", "source", "rel", "tw")


def _parts(pdf):
    adj = {r.node: list(r.out) if r.out is not None else [] for r in pdf.itertuples()}
    return adj, dict(zip(pdf["node"], pdf["rel"])), sorted(pdf.loc[pdf["hop"] == 0, "node"])


@query("best_first")
def best_first(spark, sf):
    """Over the whole graph, at any depth. Neighbours are fetched of the nodes that the search
    expands on what is known so far, until it expands none whose neighbours aren't known: the order
    is then that of the whole graph. A round fetches at most BUDGET nodes a query, and one at least
    that the search does expand, so there are no more than BUDGET rounds."""
    e, n = cut(N.edges(spark, sf)), cut(_nodes(spark, sf))

    def fetched(need: DataFrame) -> DataFrame:
        step = need.join(e.withColumnRenamed("src", "node"), "node").select("query_id", F.col("node").alias("src"), F.col("dst").alias("node"))
        near = _relevance(spark, sf, step, n).groupBy("query_id", F.col("src").alias("node")).agg(F.collect_list(F.struct(F.col("node").alias("n"), "rel", "covers")).alias("out"))
        return need.join(near, ["query_id", "node"], "left")

    def kernel(pdf):
        adj, rel, covers = {}, {}, {}
        for r in pdf.itertuples():
            out = [] if r.out is None else r.out
            adj[r.node] = [x["n"] for x in out]
            rel.update((x["n"], x["rel"]) for x in out)
            covers.update((x["n"], list(x["covers"])) for x in out)
        own = pdf.loc[pdf["seed"].notna()]
        rel.update(zip(own["node"], own["seed"]))
        entities = {e for x in own["entities"] for e in x}
        got = kernels.best_first(adj, rel, sorted(own["node"]), BUDGET, covers=covers, entities=entities)
        parents = {x: p for x, _, p, _, _ in got}
        return [(pdf["query_id"][0], i, x, d, p, s, w, ">".join(kernels.path_to(parents, x)), x in adj) for i, (x, d, p, s, w) in enumerate(got)]

    start = _relevance(spark, sf, N.seeds(spark, sf), n).select("query_id", "node", F.col("rel").alias("seed"), "entities")
    known = cut(fetched(start))
    while True:
        trace = cut(kernels.per_query(known, kernel, "query_id string, step long, node string, depth long, parent string, priority double, stop string, path string, known boolean"))
        need = trace.where("not known").select("query_id", "node", F.lit(None).cast("double").alias("seed"), F.lit(None).cast("array<string>").alias("entities"))
        if need.isEmpty():
            return trace.drop("known")
        known = cut(known.unionByName(fetched(need)))


@query("bridge")
def bridge(spark, sf):
    """Two nodes are as alike as the words of their titles, by the cosine."""

    def kernel(pdf):
        adj, rel, seeds = _parts(pdf)
        words = {n: set(w) for n, w in zip(pdf["node"], pdf["tw"])}
        anchors = sorted(pdf["node"], key=lambda n: (-rel[n], n))[:ANCHORS]

        def sim(a, b):
            x, y = words[a], words[b]
            return len(x & y) / (len(x) * len(y)) ** 0.5 if x and y else 0.0

        got = kernels.bridge(list(pdf["node"]), rel, adj, sim, seeds, anchors)
        return [(pdf["query_id"][0], n, round(s, 6)) for n, s in got.items()]

    return kernels.per_query(_balls(spark, sf), kernel, "query_id string, node string, score double")


@query("cover_graph")
def cover_graph(spark, sf):
    def kernel(pdf):
        adj, _, _ = _parts(pdf)
        mass = dict(zip(pdf["node"], pdf["mass"]))
        return [(pdf["query_id"][0], i, n) for i, n in enumerate(kernels.spread_greedy(list(pdf["node"]), mass, adj, PICKS))]

    return kernels.per_query(_balls(spark, sf), kernel, "query_id string, place long, node string")


@query("think_act_observe")
def think_act_observe(spark, sf):
    """The gated traversal; partitions are sources, similarity of nodes is the Jaccard of their
    neighbour sets."""

    def kernel(pdf):
        adj, rel, seeds = _parts(pdf)
        sets = {n: set(a) for n, a in adj.items()}
        names = {s: i for i, s in enumerate(sorted(set(pdf["source"].fillna(""))))}
        pid = {n: names[s] for n, s in zip(pdf["node"], pdf["source"].fillna(""))}
        cen = {p: float(np.mean([rel[n] for n in pid if pid[n] == p])) for p in names.values()}

        def sim(a, b):
            x, y = sets.get(a, set()), sets.get(b, set())
            return len(x & y) / len(x | y) if x | y else 0.0

        got = kernels.Agent(rel, sim, pid, cen, adj).run([(s, rel[s]) for s in seeds])
        return [(pdf["query_id"][0], *t[:4], round(t[4], 6), t[5]) for t in got]

    return kernels.per_query(_balls(spark, sf), kernel, "query_id string, step long, node string, depth long, parent string, score double, action string")


@query("cover_greedy")
def cover_greedy(spark, sf):
    """Coverage-greedy choice among the 1,200 best of each vector query, six times the picks."""
    d = R.dense(spark, sf, 6 * PICKS).join(R.items(spark, sf).select("doc_id", "vec"), "doc_id").select("query_id", F.col("doc_id").alias("node"), "score", unit(F.col("vec")).alias("vec"))

    def kernel(pdf):
        got = kernels.cover_greedy(list(pdf["node"]), pdf["score"].to_numpy(), np.stack(pdf["vec"]), PICKS)
        return [(pdf["query_id"][0], i, int(n)) for i, n in enumerate(got)]

    return kernels.per_query(d, kernel, "query_id long, place long, node long")


_PICK = "p{i} as (select query_id, arg_min(pid, struct_pack(n := -n, pid := pid)) as pid from (select query_id, pid, count(distinct node) as n from o{j} group by 1, 2) group by 1), o{i} as (select o.* from o{j} o where not exists (select 1 from o{j} x join p{i} p using (query_id, pid) where x.query_id = o.query_id and x.node = o.node))"


@query("min_cover", f"""with {R.E}, {R.GOLD}, {R.ONEHOP}, o0 as (select g.query_id, g.doc_id as node, m.pid from gold g join m1 m using (doc_id)), {", ".join(_PICK.format(i=i, j=i - 1) for i in (1, 2, 3))},
    pk as (select query_id, string_agg(pid::VARCHAR, ',' order by i) as picked from (select *, 1 as i from p1 union all select *, 2 from p2 union all select *, 3 from p3) group by 1)
    select q.query_id, q.query_id not in (select query_id from o3) as covered, picked from (select distinct query_id from o0) q left join pk using (query_id)""")
def min_cover(spark, sf):
    """Whether the golds' partitions can be covered with three picks."""
    g = R.golds(spark, sf).join(R.member_onehop(spark, sf), "doc_id").select("query_id", F.col("doc_id").alias("node"), "pid")

    def kernel(pdf):
        ok, picked = kernels.min_cover([set(x) for _, x in pdf.groupby("node")["pid"]], 3)
        return [(pdf["query_id"][0], bool(ok), ",".join(map(str, picked)))]

    return kernels.per_query(g, kernel, "query_id long, covered boolean, picked string")


@query("soar")
def soar(spark, sf):
    """Two partitions a vector; centroids, few by nature, are held by the tasks."""
    import pandas as pd

    got = partition.held_centroids(partition.centroids(R.items(spark, sf))).to_pandas()
    held = spark.sparkContext.broadcast((got["pid"].to_numpy(), np.stack(got["vec"])))

    def run(batches):
        pids, c = held.value
        for pdf in batches:
            if len(pdf):
                m = kernels.soar(np.stack(pdf["vec"]), c, 2)
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), 2), "place": np.tile([0, 1], len(pdf)), "pid": pids[m.ravel()]})

    return R.items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec")).mapInPandas(run, "doc_id long, place long, pid long")


@query("subcentroids")
def subcentroids(spark, sf):
    """Two sub-centroids a partition."""
    return partition.subcentroids(R.items(spark, sf), 2)


@query("relation_offsets")
def relation_offsets(spark, sf):
    """Offsets between linked vectors, clustered by MLlib's k-means with a fixed seed, and how large
    each cluster is."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    it = R.items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec"))
    e = R.chain_edges(spark, sf)
    d = e.join(it.toDF("src", "a"), "src").join(it.toDF("dst", "b"), "dst").select("src", "dst", array_to_vector(F.zip_with("b", "a", lambda x, y: x - y)).alias("features"))
    model = KMeans(k=4, seed=5, maxIter=10).fit(d)
    return model.transform(d).groupBy(F.col("prediction").cast("long").alias("relation")).agg(F.count(F.lit(1)).alias("edges"))


_PT = R.MIRROR + ", tp as (select src, dst, 1.0 / count(*) over (partition by src) as p from ed), x as (select doc_id as node, i - 1 as d, v[i] as x from u, range(1, 65) r(i))"


@query("appnp", f"""with {R.U}, {_PT}, h1 as (select node, d, sum(x) as x from (select tp.src as node, x.d, 0.5 * tp.p * x.x as x from tp join x on x.node = tp.dst union all select node, d, 0.5 * x from x) group by 1, 2),
    h2 as (select node, d, sum(x) as x from (select tp.src as node, h1.d, 0.5 * tp.p * h1.x as x from tp join h1 on h1.node = tp.dst union all select node, d, 0.5 * x from x) group by 1, 2) select node, d::BIGINT as d, round(x, 6) as x from h2""")
def appnp(spark, sf):
    """Two diffusion steps of the vectors over the partition chains."""
    p = graph.transition(R.chain_edges(spark, sf))
    x = R.items(spark, sf).select(F.col("doc_id").alias("node"), F.posexplode(unit(F.col("vec"))).alias("d", "x"))
    h = graph.diffuse(x, p, 0.5, 2)
    return h.select("node", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


_STEP = "w{i} as (select w.query_id, w.start, arg_min(ed.dst, md5('13:{i}:' || w.query_id || ':' || ed.dst)) as node from w{j} w join ed on ed.src = w.node group by 1, 2)"
_WALK = ", ".join(_STEP.format(i=i, j=i - 1) for i in range(1, 4))


@query("random_walks", f"with {N.BASE}, w0 as (select query_id, node as start, node from se), {_WALK} " + " union all ".join(f"select query_id, start, node, {i} as step from w{i}" for i in range(4)))
def random_walks(spark, sf):
    """Three seeded steps from every question's golds: the next node is, of all neighbours, the one of
    the smallest hash of (seed, step, query, node)."""
    e = cut(N.edges(spark, sf))
    at = N.seeds(spark, sf).select("query_id", F.col("node").alias("start"), "node", F.lit(0).alias("step"))
    out = at
    for i in range(1, 4):
        go = at.join(e, at["node"] == e["src"]).groupBy("query_id", "start").agg(F.min_by("dst", F.md5(F.concat(F.lit(f"13:{i}:"), "query_id", F.lit(":"), "dst"))).alias("node"))
        at = go.select("query_id", "start", "node", F.lit(i).alias("step"))
        out = out.unionByName(at)
    return out


_FIVE = R.U + ", " + R._list("dense", "u", 5)
_FAR = f"far as (select q, doc_id from (select a.doc_id as q, b.doc_id, row_number() over (partition by a.doc_id order by round(list_dot_product(a.v, b.v), 6) desc, b.doc_id) as r from u a, u b where a.doc_id <> b.doc_id and a.doc_id in (select doc_id from dense)) where r <= 5)"


@query("semantic_reach", f"with {_FIVE}, {_FAR} select query_id, doc_id, min(hop) as hop from (select query_id, doc_id, 1 as hop from dense union all select d.query_id, far.doc_id, 2 from dense d join far on far.q = d.doc_id) where query_id <> doc_id group by 1, 2")
def semantic_reach(spark, sf):
    """Implicit traversal: the five nearest of the five nearest, by vectors alone."""
    d = R.dense(spark, sf, 5)
    it = R.items(spark, sf)
    front = d.select(F.col("doc_id").alias("query_id")).distinct().join(it.withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", "vec")
    far = topk(front, it, 5, "unit", exclude_self=True).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("next"))
    two = d.select("query_id", "doc_id").join(far, "doc_id").select("query_id", F.col("next").alias("doc_id"), F.lit(2).alias("hop"))
    one = d.select("query_id", "doc_id", F.lit(1).alias("hop"))
    return one.unionByName(two).where("query_id <> doc_id").groupBy("query_id", "doc_id").agg(F.min("hop").alias("hop"))


_TWO = f"""s5 as (select query_id, doc_id as node from dense where rnk <= 5), h1 as (select distinct s.query_id, e.dst as node from s5 s join lm e on e.src = s.node), h2 as (select distinct h.query_id, e.dst as node from h1 h join lm e on e.src = h.node),
    hp as (select query_id, node, min(hop) as hop from (select *, 0 as hop from s5 union all select *, 1 from h1 union all select *, 2 from h2) group by 1, 2)"""


@query("budget_matched", f"""with {R.DENSE}, {R.LINKS}, {_TWO}, g as (select h.query_id, s.doc_id, row_number() over (partition by h.query_id order by h.hop, s.score desc, s.doc_id) as rnk from hp h join dense_s s on s.query_id = h.query_id and s.doc_id = h.node where h.hop > 0),
    t as (select query_id, doc_id, min(struct_pack(t := t, r := r)) as p from (select query_id, doc_id, 0 as t, rnk as r from dense where rnk <= 25 union all select query_id, doc_id, 1, rnk from g union all select query_id, doc_id, 2, rnk from dense) group by 1, 2)
    select * from (select query_id, row_number() over (partition by query_id order by p.t, p.r, doc_id) as rnk, doc_id, p.t::BIGINT as tier from t) where rnk <= 50""")
def budget_matched(spark, sf):
    """Half of the budget by vectors, half by the graph: one hop, then two, by similarity."""
    d = R.dense(spark, sf, 50)  # as many as the whole budget
    reached = graph.reach(d.where("rnk <= 5").select("query_id", F.col("doc_id").alias("node")), R.id_links(spark, sf), 2).where("hop > 0")
    from pyspark.sql import Window as W

    g = R.scored(spark, sf, reached.select("query_id", F.col("node").alias("doc_id"), "hop").where("doc_id <> query_id"))
    g = g.withColumn("rnk", F.row_number().over(W.partitionBy("query_id").orderBy("hop", F.desc("score"), "doc_id")).cast("long"))
    return fusion.tiers([(d, 25), (g, None), (d, None)], 50)


@query("learned_gate")
def learned_gate(spark, sf):
    """A learned fusion gate: logistic regression on reciprocal ranks, MLlib, of gold or not. It is
    fitted on the queries of one half, told by a hash, and ranks those of the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = R.lists(spark, sf)
    rr = lambda n: own[n].select("query_id", "doc_id", (1.0 / (60 + F.col("rnk"))).alias(n))
    f = rr("dense").join(rr("sign"), ["query_id", "doc_id"], "full_outer").fillna(0.0).join(R.golds(spark, sf).withColumn("y", F.lit(1.0)), ["query_id", "doc_id"], "left").fillna(0.0, ["y"])
    x = VectorAssembler(inputCols=["dense", "sign"], outputCol="features").transform(f)
    half = F.pmod(F.xxhash64("query_id"), F.lit(2))
    model = LogisticRegression(labelCol="y", maxIter=20, regParam=0.01).fit(x.where(half == 0))
    from pyspark.ml.functions import vector_to_array

    s = model.transform(x.where(half == 1)).select("query_id", "doc_id", F.round(vector_to_array("probability")[1], 6).alias("score"))
    from evigraph.functions.vector import ranked

    return ranked(s, 50)


@query("loss_values", f"""with {R.BOTH}, {R.GOLD}, l as (select d.query_id, d.doc_id, d.score / 0.05 as x, g.doc_id is not null as pos from dense d left join gold g using (query_id, doc_id)), a as (select query_id, max(x) as m, count(*) filter (where pos) as np from l group by 1), b as (select query_id, any_value(m) as m, any_value(np) as np, ln(sum(exp(x - m))) + any_value(m) as lse, sum(x) filter (where pos) as sp, min(x) filter (where pos) as weakest from l join a using (query_id) group by 1)
    select query_id, round(lse - sp / np, 6) as info_nce, round(ln(1 + exp(least(50, lse - weakest))), 6) as barrier from b where np > 0""")
def loss_values(spark, sf):
    """Forward values of the multi-positive InfoNCE loss and of the weakest-positive barrier over the
    100 best, temperature 0.05."""
    l = R.dense(spark, sf).join(R.golds(spark, sf).withColumn("pos", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("x", F.col("score") / 0.05)  # noqa: E741
    m = l.groupBy("query_id").agg(F.max("x").alias("m"))
    b = l.join(m, "query_id").groupBy("query_id").agg(
        (F.log(F.sum(F.exp(F.col("x") - F.col("m")))) + F.first("m")).alias("lse"),
        F.avg(F.when(F.col("pos"), F.col("x"))).alias("mean"), F.min(F.when(F.col("pos"), F.col("x"))).alias("weakest"),
    )
    return b.where("mean is not null").select("query_id", F.round(F.col("lse") - F.col("mean"), 6).alias("info_nce"), F.round(F.log(1 + F.exp(F.least(F.lit(50.0), F.col("lse") - F.col("weakest")))), 6).alias("barrier"))


@query("stratified_sample", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('9:' || doc_id), doc_id) as r from documents) where r <= 3")
def stratified_sample(spark, sf):
    """Three documents of each source by the order of a seeded hash: a sampling operator."""
    from pyspark.sql import Window as W

    h = F.md5(F.concat(F.lit("9:"), F.col("doc_id").cast("string")))
    d = table(spark, sf, "documents").select("doc_id", "source").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(h, "doc_id")))
    return d.where("r <= 3").select("doc_id", "source")


@query("tree_provenance", "with recursive up(child, parent, hop) as (select doc_id, doc_id // 4, 1 from documents union all select child, parent // 4, hop + 1 from up where parent > 0) select parent as node, count(*)::BIGINT as leaves, min(hop)::BIGINT as least, max(hop)::BIGINT as most from up group by 1")
def tree_provenance(spark, sf):
    """Documents under each node of a tree of fan-out four: the closure of parents."""
    from evigraph.operators.provenance import closure

    leaves = table(spark, sf, "documents").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 4).alias("parent"))
    inner = leaves.select(F.col("parent").alias("child")).distinct()
    edges = closure(leaves, inner)
    return edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("leaves"), F.min("hop").cast("long").alias("least"), F.max("hop").cast("long").alias("most"))
