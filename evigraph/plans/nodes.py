"""Graph queries over ``nodes``: the edges are the neighbours of corpus nodes, in both directions;
the queries of traversals are the questions whose number is divisible by 100, their seeds the
neighbours, and the scale of everything is ids, never texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.operators import graph, metrics, partition
from evigraph.operators.substrate import question_golds
from evigraph.plans.registry import query
from evigraph.session import cut
from evigraph.sources.tables import once, table


def nodes(spark, sf, *columns: str) -> DataFrame:
    src = table(spark, sf, "nodes").select("node_id", F.col("metadata.type").alias("type"), F.col("metadata.source").alias("source"), F.col("metadata.title").alias("title"), "content", "neighbors")
    return once(src.select("node_id", *columns), "node_id", *columns)


def edges(spark, sf) -> DataFrame:
    return graph.mirror(graph.neighbour_edges(nodes(spark, sf, "type", "neighbors")))


def seeds(spark, sf) -> DataFrame:
    g = question_golds(nodes(spark, sf, "type", "neighbors"))
    return g.where(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long") % 100 == 0).select("query_id", F.col("doc_id").alias("node"))


N = "n as (select distinct node_id, metadata.type as type, metadata.source as source, metadata.title as title, content, neighbors from nodes)"
EDGE = N + """, d0 as (select distinct node_id as src, unnest(neighbors) as dst, type as st from n), de as (select distinct src, dst from d0 join n on n.node_id = d0.dst where src <> dst and coalesce(st, '') <> 'question' and coalesce(n.type, '') <> 'question'), ed as (select src, dst from de union select dst, src from de)"""
SEED = "go as (select distinct query_id, doc_id from (select node_id as query_id, unnest(neighbors) as doc_id from n where type = 'question') join n on n.node_id = doc_id where coalesce(n.type, '') <> 'question'), se as (select query_id, doc_id as node from go where regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 100 = 0)"
BASE = EDGE + ", " + SEED


@query("node_scan", f"with {N} select source, coalesce(type, '') as type, count(*)::BIGINT as nodes, count(content)::BIGINT as with_content from n group by 1, 2")
def node_scan(spark, sf):
    n = nodes(spark, sf, "type", "source", "content")
    return n.groupBy("source", F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("nodes"), F.count("content").alias("with_content"))


@query("canonical_edges", f"with {EDGE} select src, dst from de")
def canonical_edges(spark, sf):
    return graph.neighbour_edges(nodes(spark, sf, "type", "neighbors"))


@query("neighbors", f"with {EDGE} select src, dst from ed")
def neighbors(spark, sf):
    return edges(spark, sf)


@query("graph_stats", f"with {EDGE}, dg as (select src, count(*) as d from ed group by 1) select (select count(*) from n where coalesce(type, '') <> 'question')::BIGINT as nodes, (select count(*) from de)::BIGINT as edges, round(1 - (select count(*) from dg) / (select count(*) from n where coalesce(type, '') <> 'question'), 6) as isolated, round((select sum(d) from dg) / (select count(*) from n where coalesce(type, '') <> 'question'), 6) as mean_degree")
def graph_stats(spark, sf):
    n = nodes(spark, sf, "type", "neighbors")
    count = n.where("coalesce(type, '') <> 'question'").agg(F.count(F.lit(1)).alias("nodes"))
    e = graph.neighbour_edges(n)
    deg = graph.degrees(graph.mirror(e)).agg(F.count(F.lit(1)).alias("k"), F.sum("degree").alias("s"))
    return count.crossJoin(e.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(deg).select("nodes", "edges", F.round(1 - F.col("k") / F.col("nodes"), 6).alias("isolated"), F.round(F.col("s") / F.col("nodes"), 6).alias("mean_degree"))


@query("corpus_audit", f"""with {BASE}, c as (select * from n where coalesce(type, '') <> 'question') select (select count(*) from c)::BIGINT as docs, (select count(*) from n where type = 'question')::BIGINT as questions, round((select avg((title is not null)::INT) from c), 6) as titled,
    (select count(*) from (select distinct a.node_id, b.node_id as q from (select node_id, unnest(neighbors) as x from c) a join n b on b.node_id = a.x where b.type = 'question'))::BIGINT as leaks,
    (select count(*) from (select distinct q, x from (select node_id as q, unnest(neighbors) as x from n where type = 'question') where x not in (select node_id from n)))::BIGINT as dangling, round((select count(*) / count(distinct query_id) from go), 6) as golds_per_question""")
def corpus_audit(spark, sf):
    """Titles, document-to-question leaks, dangling golds, golds a question."""
    n = nodes(spark, sf, "type", "title", "neighbors")
    is_q = F.coalesce("type", F.lit("")) == "question"
    one = n.agg(F.count_if(~is_q).alias("docs"), F.count_if(F.coalesce(F.col("type") == "question", F.lit(False))).alias("questions"), F.round(F.avg(F.when(~is_q, F.col("title").isNotNull().cast("double"))), 6).alias("titled"))
    kinds = n.select(F.col("node_id").alias("dst"), F.col("type").alias("dt"))
    e = n.select(F.col("node_id").alias("src"), is_q.alias("sq"), F.explode(F.array_distinct("neighbors")).alias("dst")).join(kinds, "dst", "left").withColumn("known", F.col("dt").isNotNull() | F.col("dst").isin([]))
    known = n.select(F.col("node_id").alias("dst"), F.lit(1).alias("k"))
    e = e.join(known, "dst", "left")
    two = e.agg(F.count_if(~F.col("sq") & (F.col("dt") == "question")).alias("leaks"), F.count_if(F.col("sq") & F.col("k").isNull()).alias("dangling"))
    g = question_golds(n).agg(F.round(F.count(F.lit(1)) / F.count_distinct("query_id"), 6).alias("golds_per_question"))
    return one.crossJoin(two).crossJoin(g)


@query("synthetic_recovery", f"with {EDGE}, ti as (select distinct a.node_id as src, b.node_id as dst from n a join n b on a.title = b.title and a.node_id < b.node_id where a.title in (select title from n group by title having count(*) between 2 and 10)) select src, dst from ti where not exists (select 1 from ed where ed.src = ti.src and ed.dst = ti.dst)")
def synthetic_recovery(spark, sf):
    """Edges of a second source (same rare title) that the original edges have in neither direction."""
    t = nodes(spark, sf, "title").where("title is not null").select(F.col("node_id").alias("doc_id"), F.col("title").alias("entity"))
    pairs = graph.shared_entity(t, 2, 10).where("src < dst").select("src", "dst")
    return graph.without(pairs, edges(spark, sf))


@query("query_golds", f"with {BASE} select * from go")
def query_golds(spark, sf):
    return question_golds(nodes(spark, sf, "type", "neighbors"))


def _hops(h: int) -> str:
    out = "h0 as (select query_id, node, 0 as hop from se)"
    for i in range(1, h + 1):
        out += f", h{i} as (select * from h{i-1} union all select distinct s.query_id, ed.dst, {i} from h{i-1} s join ed on ed.src = s.node where s.hop = {i-1} and not exists (select 1 from h{i-1} o where o.query_id = s.query_id and o.node = ed.dst))"
    return out


@query("bfs2", f"with {BASE}, {_hops(2)} select query_id, node, hop from h2")
def bfs2(spark, sf):
    return graph.reach(seeds(spark, sf), cut(edges(spark, sf)), 2)


@query("reach_capped", f"with {BASE.replace(', go as', ', fu as (select * from ed), go as')}, cp as (select src, dst from (select *, row_number() over (partition by src order by dst) as r from ed) where r <= 3), {_hops(2).replace('join ed on ed.src', 'join cp ed on ed.src')} select query_id, node, hop from h2")
def reach_capped(spark, sf):
    """At most three neighbours a node, the first by id, as the operator's bound on hubs."""
    return graph.reach(seeds(spark, sf), cut(graph.capped(edges(spark, sf), 3)), 2)


@query("reach_capped_64")
def reach_capped_64(spark, sf):
    """The operator's own bound on hubs, 64 neighbours a node; reach_capped, held by SQL, has three."""
    return graph.reach(seeds(spark, sf), cut(graph.capped(edges(spark, sf), 64)), 2)


@query("reach_profile", f"with {BASE}, {_hops(3)} select hop, count(*)::BIGINT as nodes, count(distinct query_id)::BIGINT as queries from h3 group by hop")
def reach_profile(spark, sf):
    r = graph.reach(seeds(spark, sf), cut(edges(spark, sf)), 3)
    return r.groupBy("hop").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("query_id").alias("queries"))


@query("min_hop", f"with {BASE}, {_hops(3)}, f as (select query_id, min(node) as node from se group by 1), g as (select se.query_id, se.node from se join f using (query_id) where se.node <> f.node), se2 as (select * from f), x0 as (select query_id, node, 0 as hop from f), x1 as (select * from x0 union all select distinct s.query_id, ed.dst, 1 from x0 s join ed on ed.src = s.node where ed.dst <> s.node), x2 as (select * from x1 union all select distinct s.query_id, ed.dst, 2 from x1 s join ed on ed.src = s.node where s.hop = 1 and not exists (select 1 from x1 o where o.query_id = s.query_id and o.node = ed.dst)), x3 as (select * from x2 union all select distinct s.query_id, ed.dst, 3 from x2 s join ed on ed.src = s.node where s.hop = 2 and not exists (select 1 from x2 o where o.query_id = s.query_id and o.node = ed.dst)) select g.query_id, g.node, x3.hop from g left join x3 using (query_id, node)")
def min_hop(spark, sf):
    """Hops from a question's first gold to each of its others, null beyond three."""
    s = seeds(spark, sf)
    f = s.groupBy("query_id").agg(F.min("node").alias("node"))
    r = graph.reach(f, cut(edges(spark, sf)), 3)
    rest = s.join(f, ["query_id", "node"], "left_anti")
    return rest.join(r, ["query_id", "node"], "left").select("query_id", "node", "hop")


@query("transition", f"with {EDGE}, t as (select src, count(*) as t from ed group by 1) select src, dst, round(1.0 / t, 9)::DOUBLE as p from ed join t using (src)")
def transition(spark, sf):
    return graph.transition(edges(spark, sf)).select("src", "dst", F.round("p", 9).alias("p"))


TYPED = "ty as (select ed.src, ed.dst, greatest(case when a.source = b.source then 1.0 else 0.25 end, 0.001) as w from ed join n a on a.node_id = ed.src join n b on b.node_id = ed.dst), tt as (select src, sum(w) as t from ty group by 1), tp as (select src, dst, (w / t)::DOUBLE as p from ty join tt using (src))"


def typed(spark, sf) -> DataFrame:
    """Edges inside a source weigh 1, across sources 0.25, as structural against synthetic edges."""
    s = nodes(spark, sf, "source").select("node_id", "source")
    e = edges(spark, sf).join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst")
    return graph.transition(e.select("src", "dst", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.25).alias("w")), "w")


@query("weighted_transition", f"with {EDGE}, {TYPED} select src, dst, round(p, 9) as p from tp")
def weighted_transition(spark, sf):
    return typed(spark, sf).select("src", "dst", F.round("p", 9).alias("p"))


def _ppr(p: str, go: float, back: float, steps: int) -> str:
    out = "s0 as (select query_id, node, 1.0 / count(*) over (partition by query_id) as mass from se), m0 as (select query_id, node, mass::DOUBLE as mass from s0)"
    for i in range(1, steps + 1):
        out += f", m{i} as (select query_id, node, sum(mass) as mass from (select m.query_id, p.dst as node, {go} * m.mass * p.p as mass from m{i-1} m join {p} p on p.src = m.node union all select query_id, node, {back} * mass from s0) group by 1, 2)"
    return out


TR = "tr as (select src, dst, 1.0 / count(*) over (partition by src) as p from ed)"


@query("ppr_walk", f"with {BASE}, {TR}, {_ppr('tr', 0.5, 0.5, 4)} select query_id, node, round(mass, 12)::DOUBLE as mass from m4")
def ppr_walk(spark, sf):
    """Four power steps, alpha the probability of walking on."""
    s = seeds(spark, sf).withColumn("w", F.lit(1.0))
    return graph.pagerank(s, cut(graph.transition(edges(spark, sf))), 0.5, 4)


@query("ppr_restart", f"with {BASE}, {TYPED}, {_ppr('tp', 0.8, 0.2, 3)} select query_id, node, round(mass, 12)::DOUBLE as mass from m3")
def ppr_restart(spark, sf):
    """Three power steps over typed edges, alpha the probability of restarting."""
    s = seeds(spark, sf).withColumn("w", F.lit(1.0))
    return graph.pagerank(s, cut(typed(spark, sf)), 0.2, 3, walk=False)


@query("ppr_ball", f"with {BASE}, {TR}, {_ppr('tr', 0.5, 0.5, 4)}, {_hops(2)}, b as (select h2.query_id, h2.node, h2.hop, coalesce(round(mass, 12), 0)::DOUBLE as mass from h2 left join m4 using (query_id, node)) select query_id, node, hop, mass from (select *, row_number() over (partition by query_id order by (hop > 0)::INT, mass desc, node) as r from b) where r <= 50")
def ppr_ball(spark, sf):
    """The two-hop ball, cut at 50 nodes by mass, seeds first."""
    e = cut(edges(spark, sf))
    s = seeds(spark, sf)
    mass = graph.pagerank(s.withColumn("w", F.lit(1.0)), cut(graph.transition(e)), 0.5, 4)
    b = graph.reach(s, e, 2).join(mass, ["query_id", "node"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    w = W.partitionBy("query_id").orderBy((F.col("hop") > 0).cast("int"), F.desc("mass"), "node")
    return b.withColumn("r", F.row_number().over(w)).where("r <= 50").select("query_id", "node", "hop", "mass")


@query("ppr_ball_2500")
def ppr_ball_2500(spark, sf):
    """The operator's own size, 2,500 nodes by mass and the seeds; ppr_ball, held by SQL, has 50."""
    return graph.ball(seeds(spark, sf), cut(edges(spark, sf)), 2, 2500)


@query("traversal_lift", f"with {BASE}, {_hops(2)}, f as (select query_id, min(node) as node from se group by 1), a as (select se.query_id, count(*) as golds, count(*) filter (where se.node = f.node) as h0, count(*) filter (where se.node = f.node or exists (select 1 from ed where ed.src = f.node and ed.dst = se.node)) as h1 from se join f using (query_id) group by 1) select count(*)::BIGINT as queries, round(avg(h0 / golds), 6) as recall_seed, round(avg(h1 / golds), 6) as recall_onehop, round(avg(h1 / golds) - avg(h0 / golds), 6) as lift from a")
def traversal_lift(spark, sf):
    """Recall of the golds from the first gold alone and with its neighbours."""
    s = seeds(spark, sf)
    f = s.groupBy("query_id").agg(F.min("node").alias("node"))
    r = graph.reach(f, edges(spark, sf), 1)
    a = s.join(r, ["query_id", "node"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("g"), F.count_if(F.col("hop") == 0).alias("a"), F.count("hop").alias("b"))
    x, y = F.avg(F.col("a") / F.col("g")), F.avg(F.col("b") / F.col("g"))
    return a.agg(F.count(F.lit(1)).alias("queries"), F.round(x, 6).alias("recall_seed"), F.round(y, 6).alias("recall_onehop"), F.round(y - x, 6).alias("lift"))


@query("edge_ablation", f"with {BASE}, et as (select ed.src, ed.dst, a.source = b.source as same from ed join n a on a.node_id = ed.src join n b on b.node_id = ed.dst), k(kind) as (values ('same'), ('cross'), ('all')) select kind, count(distinct (se.query_id, et.dst))::BIGINT as reached from k join et on kind = 'all' or (kind = 'same') = et.same join se on se.node = et.src group by kind")
def edge_ablation(spark, sf):
    """Nodes reached in one hop over each kind of edge."""
    s = nodes(spark, sf, "source").select("node_id", "source")
    e = edges(spark, sf).join(s.toDF("src", "a"), "src").join(s.toDF("dst", "b"), "dst").select("src", "dst", F.coalesce(F.col("a") == F.col("b"), F.lit(None)).alias("same"))
    kinds = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("same"), "same").when(~F.col("same"), "cross")), lambda x: x.isNotNull()))
    r = seeds(spark, sf).join(e.select(F.col("src").alias("node"), "dst", kinds.alias("kind")), "node")
    return r.select("kind", "query_id", "dst").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("reached"))


@query("onehop_order", f"with {BASE}, c as (select query_id, node, 0 as tier from se union all select distinct se.query_id, ed.dst, 1 from se join ed on ed.src = se.node where not exists (select 1 from se x where x.query_id = se.query_id and x.node = ed.dst)), g as (select src as node, count(*) as d from ed group by 1) select query_id, node, tier, row_number() over (partition by query_id order by tier, coalesce(d, 0) desc, node) as rnk from c left join g using (node)")
def onehop_order(spark, sf):
    """Anchors, then their neighbours, by degree."""
    e = cut(edges(spark, sf))
    r = graph.reach(seeds(spark, sf), e, 1).join(graph.degrees(e), "node", "left")
    w = W.partitionBy("query_id").orderBy("hop", F.desc(F.coalesce("degree", F.lit(0))), "node")
    return r.select("query_id", "node", F.col("hop").alias("tier"), F.row_number().over(w).cast("long").alias("rnk"))


@query("triangle_features", f"with {EDGE}, dg as (select src as node, count(*) as degree from ed group by 1), t as (select a.src as node, count(*) // 2 as t from ed a join ed b on a.src = b.src and a.dst <> b.dst join ed c on c.src = a.dst and c.dst = b.dst group by 1) select node, degree, coalesce(t, 0)::BIGINT as triangles, case when degree > 1 then round(coalesce(t, 0) / (degree * (degree - 1) / 2), 6) else 0 end as clustering from dg left join t using (node)")
def triangle_features(spark, sf):
    return graph.triangles(edges(spark, sf))


@query("subgraph_edges", f"with {EDGE} select a.source as pid, ed.src, ed.dst from ed join n a on a.node_id = ed.src join n b on b.node_id = ed.dst and b.source = a.source")
def subgraph_edges(spark, sf):
    s = nodes(spark, sf, "source").select("node_id", "source")
    e = edges(spark, sf).join(s.toDF("src", "pid"), "src").join(s.toDF("dst", "b"), "dst")
    return e.where("pid = b").select("pid", "src", "dst")


@query("graph_components", f"with recursive {BASE}, rc(a, b) as (select src, dst from ed union select rc.a, ed.dst from rc join ed on ed.src = rc.b) select a as node, min(b) as root from rc group by 1")
def graph_components(spark, sf):
    """Connected components of the corpus graph, the smallest id as the name."""
    from evigraph.operators.components import components

    return components(edges(spark, sf).where("src < dst"))


@query("connected_fullcov", f"with {BASE}, {_hops(1)} select query_id, true as covered, (count(distinct root) = 1) as connected from (select se.query_id, se.node, (with recursive r(node) as (select se.node union select ed.dst from r join ed on ed.src = r.node join h1 on h1.query_id = se.query_id and h1.node = ed.dst) select min(node) from r) as root from se) group by 1")
def connected_fullcov(spark, sf):
    """Whether a question's golds are connected inside their own one-hop neighbourhood."""
    s = seeds(spark, sf)
    e = cut(edges(spark, sf))
    m = graph.reach(s, e, 1).select("query_id", F.col("node").alias("doc_id"))
    return graph.connected_sets(m, e, s.select("query_id", F.col("node").alias("doc_id")))


@query("neighbourhood_groups", f"with {EDGE}, r as (select src, dst, row_number() over (partition by src order by dst) - 1 as i from ed) select src, (i // 4)::BIGINT as grp, count(*)::BIGINT as members, min(dst) as first from r group by 1, 2")
def neighbourhood_groups(spark, sf):
    """A node with up to four of its neighbours at a time, in order of ids."""
    i = F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1
    r = edges(spark, sf).withColumn("grp", F.floor(i / 4).cast("long"))
    return r.groupBy("src", "grp").agg(F.count(F.lit(1)).alias("members"), F.min("dst").alias("first"))


@query("namespace_restamp", f"with {N} select 'std_' || node_id as node_id, len(neighbors)::BIGINT as n, list_transform(neighbors, lambda x: 'std_' || x)[1] as first from n")
def namespace_restamp(spark, sf):
    n = nodes(spark, sf, "neighbors")
    stamped = F.transform("neighbors", lambda x: F.concat(F.lit("std_"), x))
    return n.select(F.concat(F.lit("std_"), "node_id").alias("node_id"), F.when(F.col("neighbors").isNotNull(), F.size("neighbors")).cast("long").alias("n"), F.try_element_at(stamped, F.lit(1)).alias("first"))


@query("hub_text", f"with {EDGE}, dg as (select src, count(*) as d from ed group by 1), t as (select source, node_id, content, row_number() over (partition by source order by coalesce(d, 0) desc, node_id) as r from n left join dg on dg.src = n.node_id where coalesce(type, '') <> 'question') select source, substring(string_agg(substring(coalesce(content, ''), 1, 256), ' ' order by r), 1, 512) as hub from t where r <= 3 group by 1")
def hub_text(spark, sf):
    """Text of a source's three nodes of the highest degree; ids are ranked before texts are joined."""
    n = nodes(spark, sf, "type", "source").where("coalesce(type, '') <> 'question'")
    d = graph.degrees(edges(spark, sf)).withColumnRenamed("node", "node_id")
    w = W.partitionBy("source").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "node_id")
    top = n.join(d, "node_id", "left").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "node_id", "r")
    t = top.join(nodes(spark, sf, "content"), "node_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring(F.coalesce("content", F.lit("")), 1, 256).alias("c")))), lambda x: x["c"])
    return t.groupBy("source").agg(F.substring(F.concat_ws(" ", parts), 1, 512).alias("hub"))


@query("source_partition_centroid_degree", f"with {EDGE}, dg as (select src, count(*) as d from ed group by 1) select source, count(*)::BIGINT as nodes, round(avg(coalesce(d, 0)), 6) as mean_degree, max(coalesce(d, 0))::BIGINT as max_degree from n left join dg on dg.src = n.node_id where coalesce(type, '') <> 'question' group by source")
def source_degree(spark, sf):
    n = nodes(spark, sf, "type", "source").where("coalesce(type, '') <> 'question'")
    d = graph.degrees(edges(spark, sf)).withColumnRenamed("node", "node_id")
    x = F.coalesce("degree", F.lit(0))
    return n.join(d, "node_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg(x), 6).alias("mean_degree"), F.max(x).alias("max_degree"))
