"""Edges from vectors, partitions from edges, weighted transitions and query-guided walks over them.

The graph joins vectors of one label by the order of their ids (struct) and each query vector to its
three nearest (synthetic)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import dot, ranked, unit
from evigraph.operators import graph, lexical, partition
from evigraph.plans import retrieval as R
from evigraph.plans import text as X
from evigraph.plans.registry import query
from evigraph.session import cut

NEAR, BETA, GAMMA = 3, 0.25, 2  # nearest vectors of an edge; weight and exponent of the typed transition
SEEDS, STEPS = 10, 4

KNN = f"kn as (select query_id as src, doc_id as dst from dense where rnk <= {NEAR} union select doc_id, query_id from dense where rnk <= {NEAR})"
TYPED = f"""ty as (select src, dst, max(w) as w from (select e.src, e.dst, pow(greatest(round(list_dot_product(a.v, b.v), 6), 1e-3), {GAMMA}) * e.k as w from (select src, dst, 1.0 as k from ed union all select src, dst, {BETA} from kn) e join u a on a.doc_id = e.src join u b on b.doc_id = e.dst) group by 1, 2),
    tp as (select src, dst, w / sum(w) over (partition by src) as p from ty)"""


def _walk(seed: str, steps: int = STEPS, alpha: float = 0.5) -> str:
    """Power steps of PageRank as common table expressions, from ``seed (query_id, node, mass)``."""
    out = f"m0 as (select * from {seed})"
    for i in range(steps):
        out += f", m{i + 1} as (select query_id, node, sum(mass) as mass from (select m.query_id, tp.dst as node, {1 - alpha} * m.mass * tp.p as mass from m{i} m join tp on tp.src = m.node union all select query_id, node, {alpha} * mass from {seed}) group by 1, 2)"
    return out + f", ms as (select query_id, node, round(mass, 9) as mass from m{steps})"


SEED = f"sd as (select query_id, doc_id as node, 1.0 / {SEEDS} as mass from dense where rnk <= {SEEDS})"
BASE = f"{R.DENSE}, {R.MIRROR}, {KNN}, {TYPED}, {SEED}, {_walk('sd')}"


def knn(spark, sf) -> DataFrame:
    d = R.dense(spark, sf, NEAR)
    return graph.mirror(d.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst")))


@query("knn_edges", f"with {R.DENSE}, {KNN} select * from kn")
def knn_edges(spark, sf):
    """Each query vector and its three nearest others, both ways."""
    return knn(spark, sf)


_SPARSE = f"""with {X.POST}, {X.STAT}, {X.IDF}, {X.SPARSE}, s as (select a.doc_id as query_id, b.doc_id, round(sum(a.w * b.w), 6) as score from sv a join sv b using (term) where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id group by 1, 2),
    t as (select * from (select query_id, doc_id, {X.RANK} as rnk from s where score > 0) where rnk <= {NEAR})"""


@query("sparse_knn_edges", f"{_SPARSE} select query_id as src, doc_id as dst from t union select doc_id, query_id from t")
def sparse_knn_edges(spark, sf):
    """Documents joined to the three most alike by their term weights, of those with a term in
    common; from the query documents, both ways."""
    top = lexical.sparse_search(X.docs(spark, sf), "doc_id % 100 = 0", NEAR, exclude_self=True)
    return graph.mirror(top.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst")))


@query("isolated_bridges", f"with {R.DENSE}, {R.LINKS}, st as (select lm.src from lm join e a on a.doc_id = lm.src join e b on b.doc_id = lm.dst where a.pid = b.pid) select query_id as src, doc_id as dst from dense where rnk = 1 and query_id not in (select src from st)")
def isolated_bridges(spark, sf):
    """Nodes without an edge inside their partition get one to the vector nearest to them."""
    h = R.hard(spark, sf)
    e = R.id_links(spark, sf).join(h.toDF("src", "a"), "src").join(h.toDF("dst", "b"), "dst").where("a = b")
    alone = R.dense(spark, sf, 1).join(e.select(F.col("src").alias("query_id")).distinct(), "query_id", "left_anti")
    return alone.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"))


def _spread_sql(rounds: int) -> str:
    out = "l0 as (select doc_id as node, doc_id as label from e)"
    for i in range(rounds):
        out += f", l{i + 1} as (select l.node, coalesce(b.label, l.label) as label from l{i} l left join (select node, arg_min(label, struct_pack(n := -n, label := label)) as label from (select lm.src as node, l.label, count(*) as n from lm join l{i} l on l.node = lm.dst group by 1, 2) group by 1) b using (node))"
    return out


@query("graph_partition", f"with {R.E}, {R.LINKS}, {_spread_sql(3)} select node as doc_id, ((row_number() over (order by label, node) - 1) // 100)::BIGINT as pid from l3")
def graph_partition(spark, sf):
    """Partitions of 100 along the graph: labels spread to neighbours, communities are laid one after
    the other and cut at the target size."""
    labels = partition.spread_labels(R.hard(spark, sf).select(F.col("doc_id").alias("node")), R.id_links(spark, sf), 3)
    return partition.balanced(labels, 100).select(F.col("node").alias("doc_id"), "pid")


def typed(spark, sf) -> DataFrame:
    """Cosine-weighted transition over both kinds of edges: max(cos, 0.001) to the power GAMMA, the
    synthetic ones times BETA."""
    it = R.items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec"))
    e = graph.mirror(R.chain_edges(spark, sf)).withColumn("k", F.lit(1.0)).unionByName(knn(spark, sf).withColumn("k", F.lit(BETA)))
    e = e.join(it.toDF("src", "a"), "src").join(it.toDF("dst", "b"), "dst")
    w = F.pow(F.greatest(F.round(dot(F.col("a"), F.col("b")), 6), F.lit(1e-3)), F.lit(GAMMA)) * F.col("k")
    return graph.transition(e.select("src", "dst", w.alias("w")), "w")


@query("typed_transition", f"with {R.DENSE}, {R.MIRROR}, {KNN}, {TYPED} select src, dst, round(p, 9) as p from tp")
def typed_transition(spark, sf):
    return typed(spark, sf).withColumn("p", F.round("p", 9))


def mass(spark, sf) -> DataFrame:
    """PageRank mass from the ten best of each query, restart 0.5, four steps."""
    seeds = R.dense(spark, sf, SEEDS).select("query_id", F.col("doc_id").alias("node"), F.lit(1.0).alias("w"))
    return graph.pagerank(seeds, cut(typed(spark, sf)), 0.5, STEPS, digits=9)


@query("guided_ppr", f"with {BASE}, g as (select query_id, node as doc_id, round(mass * greatest(score, 0), 9) as score from ms join dense_s s using (query_id) where s.doc_id = ms.node) select * from (select query_id, {R.RANK} as rnk, doc_id, score from g) where rnk <= 50")
def guided_ppr(spark, sf):
    """Mass times relevance, so that a document must be both reachable and on topic."""
    m = R.scored(spark, sf, mass(spark, sf).select("query_id", F.col("node").alias("doc_id"), "mass").where("doc_id <> query_id"))
    return ranked(m.select("query_id", "doc_id", F.round(F.col("mass") * F.greatest("score", F.lit(0.0)), 9).alias("score")), 50)


@query("ner_blend", f"with {BASE}, c as (select d.query_id, d.doc_id, d.rnk, coalesce(ms.mass, 0) as mass, count(*) over (partition by d.query_id) as n from dense d left join ms on ms.query_id = d.query_id and ms.node = d.doc_id), g as (select query_id, doc_id, round(1 - (rnk - 1) / n + 0.2 * mass / (max(mass) over (partition by query_id) + 1e-9), 9) as score from c) select query_id, {R.RANK} as rnk, doc_id, score from g")
def ner_blend(spark, sf):
    """The first hundred by their rank, 1 - r/n, plus a fifth of their scaled mass."""
    d = R.dense(spark, sf).select("query_id", "doc_id", "rnk")
    c = d.join(mass(spark, sf).withColumnRenamed("node", "doc_id"), ["query_id", "doc_id"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    w = W.partitionBy("query_id")
    s = 1 - (F.col("rnk") - 1) / F.count(F.lit(1)).over(w) + 0.2 * F.col("mass") / (F.max("mass").over(w) + 1e-9)
    return ranked(c.select("query_id", "doc_id", F.round(s, 9).alias("score")))


@query("ppr_x_cos", f"with {BASE}, c as (select query_id, node as doc_id, ln(mass + 1e-12) as l, s.score as cos from ms join dense_s s using (query_id) where s.doc_id = ms.node), g as (select query_id, doc_id, round(0.72 * (l - min(l) over w) / (max(l) over w - min(l) over w + 1e-9) + 0.28 * cos, 6) as score from c window w as (partition by query_id)) select * from (select query_id, {R.RANK} as rnk, doc_id, score from g) where rnk <= 50")
def ppr_x_cos(spark, sf):
    """0.72 of the scaled log mass and 0.28 of the cosine, over what the walk reaches."""
    m = R.scored(spark, sf, mass(spark, sf).select("query_id", F.col("node").alias("doc_id"), F.log(F.col("mass") + 1e-12).alias("l")).where("doc_id <> query_id"))
    w = W.partitionBy("query_id")
    lo, hi = F.min("l").over(w), F.max("l").over(w)
    return ranked(m.select("query_id", "doc_id", F.round(0.72 * (F.col("l") - lo) / (hi - lo + 1e-9) + 0.28 * F.col("score"), 6).alias("score")), 50)


TELEPORT = f"te as (select query_id, doc_id as node, 0.7 * (rnk <= {SEEDS})::INT / {SEEDS} + 0.3 * x / sum(x) over (partition by query_id) as mass from (select *, exp((score - max(score) over (partition by query_id)) / 0.1) as x from dense))"


@query("seed_teleport", f"with {R.DENSE}, {TELEPORT} select query_id, node as doc_id, round(mass, 9) as mass from te")
def seed_teleport(spark, sf):
    """Where a walk restarts: 0.7 on the ten best alike, 0.3 by the softmax of the scores at 0.1 over
    the hundred best."""
    return teleport(spark, sf).select("query_id", F.col("node").alias("doc_id"), F.round("w", 9).alias("mass"))


def teleport(spark, sf) -> DataFrame:
    w = W.partitionBy("query_id")
    d = R.dense(spark, sf).withColumn("x", F.exp((F.col("score") - F.max("score").over(w)) / 0.1))
    own = 0.7 * (F.col("rnk") <= SEEDS).cast("double") / SEEDS + 0.3 * F.col("x") / F.sum("x").over(w)
    return d.select("query_id", F.col("doc_id").alias("node"), own.alias("w"))


@query("teleport_ppr", f"with {R.DENSE}, {R.MIRROR}, {KNN}, {TYPED}, {TELEPORT}, {_walk('te')} select * from (select query_id, row_number() over (partition by query_id order by mass desc, node) as rnk, node as doc_id, mass as score from ms) where rnk <= 50")
def teleport_ppr(spark, sf):
    m = graph.pagerank(teleport(spark, sf), cut(typed(spark, sf)), 0.5, STEPS, digits=9)
    return ranked(m.select("query_id", F.col("node").alias("doc_id"), F.col("mass").alias("score")), 50)


BALL = f"""b0 as (select query_id, doc_id as node from dense where rnk <= {SEEDS}), b1 as (select query_id, node from b0 union select b.query_id, ed.dst from b0 b join ed on ed.src = b.node), b2 as (select query_id, node from b1 union select b.query_id, ed.dst from b1 b join ed on ed.src = b.node),
    bl as (select b.query_id, b.node, s.score from b2 b join dense_s s on s.query_id = b.query_id and s.doc_id = b.node), be as (select a.query_id, a.node as src, b.node as dst, exp(b.score / 0.1) as w from bl a join ed on ed.src = a.node join bl b on b.query_id = a.query_id and b.node = ed.dst), bp as (select query_id, src, dst, w / sum(w) over (partition by query_id, src) as p from be),
    bs as (select query_id, node, greatest(score, 1e-3) / sum(greatest(score, 1e-3)) over (partition by query_id) as mass from bl join b0 using (query_id, node))"""


def _biased_sql(steps: int) -> str:
    out = "q0 as (select * from bs)"
    for i in range(steps):
        out += f", q{i + 1} as (select query_id, node, sum(mass) as mass from (select q.query_id, bp.dst as node, 0.85 * q.mass * bp.p as mass from q{i} q join bp on bp.query_id = q.query_id and bp.src = q.node union all select query_id, node, 0.15 * mass from bs) group by 1, 2)"
    return out


@query("biased_walk", f"with {R.DENSE}, {R.MIRROR}, {BALL}, {_biased_sql(5)}, g as (select query_id, node as doc_id, round(mass, 9) as score from q5) select * from (select query_id, {R.RANK} as rnk, doc_id, score from g) where rnk <= 50")
def biased_walk(spark, sf):
    """A walk inside each query's two-hop ball whose steps lean to what is relevant, by exp(score /
    0.1) of where they lead, restarting at the seeds by their relevance."""
    e = cut(graph.mirror(R.chain_edges(spark, sf)))
    seeds = R.dense(spark, sf, SEEDS).select("query_id", F.col("doc_id").alias("node"))
    near = graph.reach(seeds, e, 2).select("query_id", F.col("node").alias("doc_id"), "hop").where("doc_id <> query_id")
    ball = cut(R.scored(spark, sf, near).select("query_id", F.col("doc_id").alias("node"), "score", "hop"))
    inside = ball.select("query_id", F.col("node").alias("src")).join(e, "src").join(ball.select("query_id", F.col("node").alias("dst"), F.exp(F.col("score") / 0.1).alias("w")), ["query_id", "dst"])
    p = cut(inside.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("query_id", "src"))).select("query_id", "src", "dst", "p"))
    start = ball.where("hop = 0").withColumn("w", F.greatest("score", F.lit(1e-3)))
    m = graph.walk_inside(start.select("query_id", "node", "w"), p, 0.85, 5)
    return ranked(m.select("query_id", F.col("node").alias("doc_id"), F.round("mass", 9).alias("score")), 50)


@query("beam_two_hop", f"with {R.DENSE}, {R.MIRROR}, {BALL} select * from (select query_id, {R.RANK} as rnk, doc_id, score from (select query_id, node as doc_id, score from bl)) where rnk <= 50")
def beam_two_hop(spark, sf):
    """What two hops from the ten best reach, by relevance."""
    seeds = R.dense(spark, sf, SEEDS).select("query_id", F.col("doc_id").alias("node"))
    near = graph.reach(seeds, graph.mirror(R.chain_edges(spark, sf)), 2).select("query_id", F.col("node").alias("doc_id"))
    return ranked(R.scored(spark, sf, near.where("doc_id <> query_id")), 50)
