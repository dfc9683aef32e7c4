"""Retrieval from several positions, learned and gated fusion, memberships by other edges, and
diagnostics of misses, over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import dot, mean_by, ranked, topk, unit
from evigraph.operators import fusion, graph, metrics, partition
from evigraph.plans import retrieval as R
from evigraph.plans import substrate as S
from evigraph.plans.registry import query


def units(spark, sf) -> DataFrame:
    return R.items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec"))


# --- several positions ----------------------------------------------------------------------------
_SEEDED = f"""se as (select query_id, doc_id as seed, rnk as sr from dense where rnk <= 3), sl as (select * from (select se.query_id, se.seed, b.doc_id, row_number() over (partition by se.query_id, se.seed order by round(list_dot_product(a.v, b.v), 6) desc, b.doc_id) as rnk from se join u a on a.doc_id = se.seed join u b on b.doc_id <> se.seed) where rnk <= 20)"""


@query("multi_seed_rrf", f"with {R.DENSE}, {_SEEDED}, f as (select query_id, doc_id, round(sum(1.0 / (60 + rnk)), 9) as score from (select query_id, doc_id, rnk from sl union all select query_id, doc_id, rnk from dense where rnk <= 20) where doc_id <> query_id group by 1, 2) select * from (select query_id, {R.RANK} as rnk, doc_id, score from f) where rnk <= 50")
def multi_seed_rrf(spark, sf):
    """The three best hits are searched again, and their lists fused with the query's own."""
    d = R.dense(spark, sf, 20)
    seeds = d.where("rnk <= 3").select("query_id", F.col("doc_id").alias("seed"))
    again = topk(seeds.select(F.col("seed").alias("query_id")).distinct().join(units(spark, sf).withColumnRenamed("doc_id", "query_id"), "query_id"), units(spark, sf), 20, exclude_self=True)
    more = seeds.join(again.withColumnRenamed("query_id", "seed"), "seed").select("query_id", "doc_id", "rnk")
    every = d.select("query_id", "doc_id", "rnk").unionByName(more).where("doc_id <> query_id")
    return ranked(every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rnk"))), 9).alias("score")), 50)


_OFFSET = """oa as (select a.pid, i, avg(b.v[i] - a.v[i]) as x from ch join u a on a.doc_id = ch.src join u b on b.doc_id = ch.dst, range(1, 65) r(i) group by 1, 2), of as (select pid, list(x order by i) as o from oa group by 1),
    mv as (select u.doc_id as query_id, list_transform(list_zip(u.v, of.o), lambda z: z[1] + z[2]) as v from u join of using (pid) where u.doc_id % 100 = 0)"""


def offsets(spark, sf) -> DataFrame:
    """``(pid, o)``: the mean step from a vector to the next one linked to it, by label."""
    it = R.items(spark, sf).select("doc_id", "pid", unit(F.col("vec")).alias("vec"))
    e = R.chain_edges(spark, sf).join(it.toDF("src", "pid", "a"), "src").join(it.select(F.col("doc_id").alias("dst"), F.col("vec").alias("b")), "dst")
    long = e.select("pid", F.posexplode(F.zip_with("b", "a", lambda x, y: x - y)).alias("d", "x")).groupBy("pid", "d").agg(F.avg("x").alias("x"))
    return long.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("o"))  # one entry a dimension


@query("offset_retrieval", f"with {R.U}, {R.CHAIN}, {_OFFSET}, s as (select mv.query_id, u.doc_id, round(list_dot_product(mv.v, u.v) / sqrt(list_dot_product(mv.v, mv.v)), 6) as score from mv, u where u.doc_id <> mv.query_id) select * from (select query_id, {R.RANK} as rnk, doc_id, score from s) where rnk <= 20")
def offset_retrieval(spark, sf):
    """Queries moved by the offset of their label, at length 1."""
    q = R.asked(spark, sf).join(partition.small(offsets(spark, sf)), "pid").select("query_id", unit(F.zip_with(unit(F.col("vec")), "o", lambda a, b: a + b)).alias("vec"))
    return topk(q, units(spark, sf), 20, exclude_self=True)


@query("offset_reach", f"with {R.DENSE}, {R.CHAIN}, {_OFFSET}, fr as (select query_id, doc_id as node from dense where rnk <= 2), p as (select distinct fr.query_id, fr.node, of.pid from fr, of), s as (select * from (select m.query_id, m.node, m.pid, b.doc_id, row_number() over (partition by m.query_id, m.node, m.pid order by round(list_dot_product(m.v, b.v) / sqrt(list_dot_product(m.v, m.v)), 6) desc, b.doc_id) as r from (select p.*, list_transform(list_zip(a.v, of.o), lambda z: z[1] + z[2]) as v from p join u a on a.doc_id = p.node join of on of.pid = p.pid) m join u b on b.doc_id <> m.node) where r <= 2) select query_id, doc_id, count(*)::BIGINT as ways from s where doc_id <> query_id group by 1, 2")
def offset_reach(spark, sf):
    """Hops without edges: the two nearest of each of the two best hits moved by each offset."""
    front = R.dense(spark, sf, 2).select("query_id", F.col("doc_id").alias("node"))
    starts = front.select("node").distinct().join(units(spark, sf).withColumnRenamed("doc_id", "node"), "node")
    table = [(r["pid"], r["o"]) for r in offsets(spark, sf).limit(1025).collect()]  # one row a label
    if len(table) > 1024:
        raise ValueError("more than 1024 offsets")
    steps = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pid"), F.array(*map(F.lit, o)).alias("o")) for p, o in table])).alias("s")
    moved = starts.select("node", "vec", steps).select((F.col("node") * 1024 + F.col("s.pid")).alias("query_id"), unit(F.zip_with("vec", "s.o", lambda a, b: a + b)).alias("vec"))
    got = topk(moved, units(spark, sf), 3).withColumn("node", F.floor(F.col("query_id") / 1024)).where("doc_id <> node")
    got = got.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rnk"))).where("r <= 2")
    return front.join(got.select("node", "doc_id"), "node").where("doc_id <> query_id").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("ways"))


@query("graph_vector", f"with {R.DENSE}, a as (select d.query_id, i - 1 as d, avg(u.v[i]) as x from dense d join u using (doc_id), range(1, 65) r(i) where d.rnk <= 5 group by 1, 2) select query_id, d::BIGINT as d, round(x / sqrt(sum(x * x) over (partition by query_id)), 6) as x from a")
def graph_vector(spark, sf):
    """A query's subgraph as one vector: the mean of its five best."""
    v = R.dense(spark, sf, 5).select("query_id", "doc_id").join(units(spark, sf), "doc_id")
    return mean_by(v, ["query_id"], "vec").select("query_id", F.posexplode("vec").alias("d", "x")).select("query_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


HIDDEN = 16
_MLP = f"""hi as (select doc_id as query_id, list_transform(range(0, {HIDDEN}), lambda h: greatest(0, list_sum(list_transform(range(0, 64), lambda d: v[d + 1] * cos(h * d + 1.0))))) as h from u where doc_id % 100 = 0),
    po as (select query_id, list_transform(range(0, 64), lambda d: list_sum(list_transform(range(0, {HIDDEN}), lambda k: h[k + 1] * sin(d + 3.0 * k)))) as v from hi)"""


def projected(v, hidden: int = HIDDEN):
    """Linear, ReLU, linear, length 1. The weights stand in for trained ones: cos(h d + 1) and sin(d + 3 h)."""
    import math

    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    h = F.array(*[F.greatest(F.lit(0.0), dot(v, lit([math.cos(k * d + 1.0) for d in range(64)]))) for k in range(hidden)])
    return lambda own: unit(F.array(*[dot(own, lit([math.sin(d + 3.0 * k) for k in range(hidden)])) for d in range(64)])), h


@query("mlp_routing", f"with {R.U}, {R.CENTROID}, {_MLP}, s as (select po.query_id, c.pid, round(list_dot_product(po.v, c.v) / sqrt(list_dot_product(po.v, po.v)), 6) as score from po, c where list_dot_product(po.v, po.v) > 0) select query_id, pid, score, row_number() over (partition by query_id order by score desc, pid) as rnk from s")
def mlp_routing(spark, sf):
    """Partitions by the query's projection through two layers."""
    q = R.asked(spark, sf).withColumn("vec", unit(F.col("vec")))
    out, h = projected(F.col("vec"))
    q = q.withColumn("h", h).select("query_id", out(F.col("h")).alias("vec"))
    cents = partition.centroids(R.items(spark, sf)).select(F.col("pid").alias("doc_id"), "vec")
    return topk(q, cents, 10).select("query_id", F.col("doc_id").alias("pid"), "score", "rnk")


@query("no_rerank", f"with {R.DENSE}, {R.ROUTE} select query_id, row_number() over (partition by query_id order by pr, doc_id) as rnk, doc_id from (select rt.query_id, e.doc_id, rt.rnk as pr from rt join e using (pid) where rt.rnk <= 2) qualify rnk <= 20")
def no_rerank(spark, sf):
    """The pool in its own order: routed partitions, then ids."""
    pool = R.vote_order(spark, sf).where("rnk <= 2").select("query_id", "pid", F.col("rnk").alias("pr")).join(R.hard(spark, sf), "pid")
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("pr", "doc_id")).cast("long")
    return pool.withColumn("rnk", rnk).where("rnk <= 20").select("query_id", "rnk", "doc_id")


# --- gates and tuned weights ----------------------------------------------------------------------
_GATE = "ga as (select d.query_id, least(1.2, greatest(0.1, 2 * (0.8 - count(s.doc_id) / 20.0))) as w from (select * from dense where rnk <= 20) d left join (select * from sgn where rnk <= 20) s using (query_id, doc_id) group by 1)"


@query("gated_fusion", f"with {R.BOTH}, {_GATE}, f as (select query_id, doc_id, round(sum(w / (60 + rnk)), 9) as score from (select query_id, doc_id, rnk, 1.0 as w from dense union all select s.query_id, s.doc_id, s.rnk, ga.w from sgn s join ga using (query_id)) group by 1, 2) select * from (select query_id, {R.RANK} as rnk, doc_id, score from f) where rnk <= 50")
def gated_fusion(spark, sf):
    """The second list weighs 2 (0.8 - overlap of the first twenty), between 0.1 and 1.2: the less the
    lists agree, the more it adds."""
    d, s = R.dense(spark, sf), R.signs(spark, sf)
    gate = fusion.overlap(d, s, 20).select("query_id", F.least(F.lit(1.2), F.greatest(F.lit(0.1), 2 * (0.8 - F.col("overlap")))).alias("w"))
    both = d.select("query_id", "doc_id", "rnk").withColumn("w", F.lit(1.0)).unionByName(s.select("query_id", "doc_id", "rnk").join(gate, "query_id"))
    return ranked(both.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (60 + F.col("rnk"))), 9).alias("score")), 50)


@query("margin_gate", f"with {R.DENSE}, m as (select query_id, max(score) - min(score) as margin from dense where rnk in (1, 20) group by 1), t as (select quantile_cont(margin, 0.5) as c from m) select query_id, round(margin, 6) as margin, margin >= c as sure from m, t")
def margin_gate(spark, sf):
    """Whether the first hit stands out: its lead over the twentieth against the median lead."""
    m = R.dense(spark, sf, 20).where("rnk in (1, 20)").groupBy("query_id").agg((F.max("score") - F.min("score")).alias("margin"))
    c = m.agg(F.percentile("margin", F.lit(0.5))).first()[0]
    return m.select("query_id", F.round("margin", 6).alias("margin"), (F.col("margin") >= F.lit(c)).alias("sure"))


GRID = (0.0, 0.5, 1.0, 2.0)


@query("tuned_weights")
def tuned_weights(spark, sf):
    """One weight a list by coordinate ascent on the mean recall of the golds in the first twenty: two
    passes over a grid. The lists' contributions to golds and rivals are computed once; a trial is one
    aggregation."""
    lists, g = R.lists(spark, sf), R.golds(spark, sf)
    w = fusion.ascend(lists, g, GRID, 2, 20)
    return spark.createDataFrame(sorted(w.items()), "list string, weight double")


# --- choices ---------------------------------------------------------------------------------------
@query("auto_reranker", f"with {R.BOTH}, {R.GOLD}, m as (select 'dense' as method, avg((coalesce(d.rnk, 999) <= 10)::INT) as r from gold g left join dense d using (query_id, doc_id) union all select 'sign', avg((coalesce(d.rnk, 999) <= 10)::INT) from gold g left join sgn d using (query_id, doc_id)) select arg_max(method, struct_pack(r := round(r, 9), m := method = 'dense')) as method, round(max(r), 6) as recall_10 from m")
def auto_reranker(spark, sf):
    """The method of the best stored metric; without one, or of equal ones, the dense."""
    g = R.golds(spark, sf)
    m = None
    for name, own in R.lists(spark, sf).items():
        j = g.join(own.select("query_id", "doc_id", "rnk"), ["query_id", "doc_id"], "left").agg(F.avg((F.coalesce("rnk", F.lit(999)) <= 10).cast("double")).alias("r")).withColumn("method", F.lit(name))
        m = j if m is None else m.unionByName(j)
    best = F.max(F.struct(F.round("r", 9).alias("r"), (F.col("method") == "dense").alias("d"), "method"))
    return m.agg(F.coalesce(best["method"], F.lit("dense")).alias("method"), F.round(F.max("r"), 6).alias("recall_10"))


_GP = "gp as (select query_id, count(distinct pid)::BIGINT as k from gold join e using (doc_id) group by 1)"


@query("adaptive_k", f"with {R.DENSE}, {R.ROUTE}, {R.GOLD}, {_GP}, z as (select pid, count(*) as n from e group by pid), pl as (select rt.query_id, sum(n) as pool from rt join gp using (query_id) join z using (pid) where rt.rnk <= gp.k group by 1), cv as (select g.query_id, min((rt.rnk <= gp.k)::INT) as c from gold g join e using (doc_id) join gp using (query_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid group by 1) select round(avg(pool), 6) as pool, round(100 * avg(c), 6) as full_coverage from pl join cv using (query_id)")
def adaptive_k(spark, sf):
    """As many partitions as a query's golds lie in: the mean pool, and how often it holds them all."""
    h, order, g = R.hard(spark, sf), R.vote_order(spark, sf).select("query_id", "pid", "rnk"), R.golds(spark, sf)
    own = g.join(h, "doc_id")
    k = own.groupBy("query_id").agg(F.count_distinct("pid").alias("k"))
    z = h.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    pool = order.join(k, "query_id").where("rnk <= k").join(z, "pid").groupBy("query_id").agg(F.sum("n").alias("pool"))
    cov = own.join(order, ["query_id", "pid"]).join(k, "query_id").groupBy("query_id").agg(F.min((F.col("rnk") <= F.col("k")).cast("int")).alias("c"))
    return pool.join(cov, "query_id").agg(F.round(F.avg("pool"), 6).alias("pool"), F.round(100 * F.avg("c"), 6).alias("full_coverage"))


# --- memberships -----------------------------------------------------------------------------------
_SYN = f"{S.KNN}, syn as (select doc_id, pid from e union select kn.src, e.pid from kn join e on e.doc_id = kn.dst)"


@query("member_synthetic", f"with {R.DENSE}, {_SYN} select * from syn")
def member_synthetic(spark, sf):
    """Own partition and those of the synthetic neighbours."""
    return partition.onehop(R.hard(spark, sf), S.knn(spark, sf))


_EXTRA = "ex as (select a.doc_id as src, b.doc_id as dst from e a join e b on b.doc_id = a.doc_id + 7), xm as (select doc_id, pid from e union select src, e.pid from (select src, dst from ex union select dst, src from ex) x join e on e.doc_id = x.dst)"


@query("member_external", f"with {R.E}, {_EXTRA} select * from xm")
def member_external(spark, sf):
    """Own partition and those of the neighbours in an edge table given from outside."""
    h = R.hard(spark, sf)
    given = h.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 7).alias("dst")).join(h.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    return partition.onehop(h, graph.mirror(given))


@query("member_composed", f"with {R.DENSE}, {_SYN}, {_EXTRA} select * from syn union select * from xm")
def member_composed(spark, sf):
    """The union of two memberships."""
    return member_synthetic(spark, sf).unionByName(member_external(spark, sf)).distinct()


# --- diagnostics -----------------------------------------------------------------------------------
@query("metrics_seeds", f"with {R.BOTH}, {R.GOLD}, r as (select l.list, g.query_id, avg((coalesce(h.rnk, 999) <= 20)::INT) as r from gold g cross join (values ('dense'), ('sign')) l(list) left join ({R.HALL}) h on h.list = l.list and h.query_id = g.query_id and h.doc_id = g.doc_id group by 1, 2), s as (select list, (query_id // 100) % 3 as seed, avg(r) as r from r group by 1, 2) select list, count(*)::BIGINT as seeds, round(avg(r), 6) as mean, round(stddev_pop(r), 6) as std from s group by grouping sets ((list), ())")
def metrics_seeds(spark, sf):
    """Mean and spread of the recall over three runs (queries by their number), per list and overall."""
    g, out = R.golds(spark, sf), None
    for name, own in R.lists(spark, sf).items():
        m = metrics.per_query(own, g, [20]).select(F.lit(name).alias("list"), (F.floor(F.col("query_id") / 100) % 3).alias("seed"), F.col("recall_20").alias("r"))
        out = m if out is None else out.unionByName(m)
    s = out.groupBy("list", "seed").agg(F.avg("r").alias("r"))
    return s.rollup("list").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("std"))


_AL = f"al as (select query_id, doc_id, {R.RANK} as rnk from dense_s)"
_LM1 = "n1 as (select distinct g.query_id, lm.dst as doc_id from (select query_id, doc_id from dense where rnk <= 10) g join lm on lm.src = g.doc_id)"


@query("miss_buckets", f"with {R.BOTH}, {R.GOLD}, {R.LINKS}, {_AL}, {_LM1}, mi as (select g.query_id, g.doc_id, al.rnk from gold g join al using (query_id, doc_id) left join dense d on d.query_id = g.query_id and d.doc_id = g.doc_id and d.rnk <= 20 where d.doc_id is null), b as (select case when s.doc_id is not null then 'fusion' when mi.rnk <= 100 then 'rerank' when n1.doc_id is not null then 'neighbour' when mi.rnk <= 200 then 'near' else 'far' end as bucket from mi left join (select * from sgn where rnk <= 20) s using (query_id, doc_id) left join n1 using (query_id, doc_id)) select bucket, count(*)::BIGINT as golds from b group by 1")
def miss_buckets(spark, sf):
    """Why golds are missed by the first twenty: another list has them, a deeper cut has them, a
    neighbour of the first ten is them, or they are near or far by their rank in the whole ranking."""
    from evigraph.functions.vector import rank_of

    d = R.dense(spark, sf)
    miss = R.golds(spark, sf).join(d.where("rnk <= 20").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    miss = miss.join(rank_of(R.asked(spark, sf), R.items(spark, sf), miss), ["query_id", "doc_id"])
    other = R.signs(spark, sf, 20).select("query_id", "doc_id", F.lit(1).alias("s"))
    near = d.where("rnk <= 10").join(R.id_links(spark, sf).withColumnRenamed("src", "doc_id"), "doc_id").select("query_id", F.col("dst").alias("doc_id"), F.lit(1).alias("n")).distinct()
    j = miss.join(other, ["query_id", "doc_id"], "left").join(near, ["query_id", "doc_id"], "left")
    bucket = F.when(F.col("s").isNotNull(), "fusion").when(F.col("rnk") <= 100, "rerank").when(F.col("n").isNotNull(), "neighbour").when(F.col("rnk") <= 200, "near").otherwise("far")
    return j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("golds"))


@query("partition_span", f"with {R.DENSE}, {R.ROUTE}, {R.GOLD}, q as (select g.query_id, count(distinct e.pid)::BIGINT as span, max(rt.rnk) as worst from gold g join e using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid group by 1) select span, count(*)::BIGINT as queries, round(avg((worst <= 3)::INT), 6) as full_3, round(avg((span <= 3)::INT), 6) as oracle_3 from q group by 1")
def partition_span(spark, sf):
    """Over how many partitions golds are spread, and what three routed, or the best three, cover."""
    order = R.vote_order(spark, sf).select("query_id", "pid", "rnk")
    q = R.golds(spark, sf).join(R.hard(spark, sf), "doc_id").join(order, ["query_id", "pid"]).groupBy("query_id").agg(F.count_distinct("pid").alias("span"), F.max("rnk").alias("worst"))
    at_3 = lambda c: F.round(F.avg((F.col(c) <= 3).cast("double")), 6)
    return q.groupBy("span").agg(F.count(F.lit(1)).alias("queries"), at_3("worst").alias("full_3"), at_3("span").alias("oracle_3"))


_REC = """cg as (select g.query_id, g.doc_id from gold g join e using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid where rt.rnk <= 3), mg as (select query_id, doc_id from gold except select query_id, doc_id from cg), ta as (select query_id, doc_id from dense where rnk <= 10)"""


def _one_hop_sql(name: str, src: str) -> str:
    return f"{name}1 as (select distinct s.query_id, lm.dst as doc_id from {src} s join lm on lm.src = s.doc_id), {name}2 as (select query_id, doc_id from {name}1 union select s.query_id, lm.dst from {name}1 s join lm on lm.src = s.doc_id)"


@query("miss_recovery", f"with {R.DENSE}, {R.ROUTE}, {R.GOLD}, {R.LINKS}, {_REC}, {_one_hop_sql('c', 'cg')}, {_one_hop_sql('a', 'ta')} select count(*)::BIGINT as missed, count(*) filter (where (query_id, doc_id) in (select (query_id, doc_id) from c1))::BIGINT as from_golds_1, count(*) filter (where (query_id, doc_id) in (select (query_id, doc_id) from c2))::BIGINT as from_golds_2, count(*) filter (where (query_id, doc_id) in (select (query_id, doc_id) from a1))::BIGINT as from_hits_1, count(*) filter (where (query_id, doc_id) in (select (query_id, doc_id) from a2))::BIGINT as from_hits_2, (select count(*) from a2)::BIGINT as frontier from mg")
def miss_recovery(spark, sf):
    """Golds that three routed partitions miss, and how many of them one or two hops reach from the
    golds that are covered (the ceiling) and from the ten best hits."""
    e, g = R.id_links(spark, sf), R.golds(spark, sf)
    order = R.vote_order(spark, sf).where("rnk <= 3").select("query_id", "pid")
    covered = g.join(R.hard(spark, sf), "doc_id").join(order, ["query_id", "pid"], "left_semi").select("query_id", "doc_id")
    missed = g.select("query_id", "doc_id").exceptAll(covered)

    def hops(start: DataFrame, name: str) -> DataFrame:
        go = lambda df: df.join(e, F.col("doc_id") == F.col("src")).select("query_id", F.col("dst").alias("doc_id")).distinct()
        one = go(start.select("query_id", "doc_id"))
        return one.withColumn("hop", F.lit(1)).unionByName(go(one).withColumn("hop", F.lit(2))).groupBy("query_id", "doc_id").agg(F.min("hop").alias(name))

    a, b = hops(covered, "a"), hops(R.dense(spark, sf, 10), "b")
    size = b.agg(F.count(F.lit(1))).first()[0]
    j = missed.join(a, ["query_id", "doc_id"], "left").join(b, ["query_id", "doc_id"], "left")
    within = lambda c, n: F.count_if(F.coalesce(c, F.lit(9)) <= n)
    return j.agg(
        F.count(F.lit(1)).alias("missed"), within("a", 1).alias("from_golds_1"), within("a", 2).alias("from_golds_2"), within("b", 1).alias("from_hits_1"), within("b", 2).alias("from_hits_2"), F.lit(int(size)).cast("long").alias("frontier"),
    )


@query("attention_score", f"with {R.U}, {R.ROUTED}, {R.HEADS}, c0a as (select query_id, doc_id from (select query_id, doc_id, row_number() over (partition by query_id order by round(list_dot_product(a.v, u.v), 6) desc, u.doc_id) as r from (select doc_id as query_id, v from u where doc_id % 100 = 0) a, u where u.doc_id <> a.query_id) where r <= 20), s as (select hd.query_id, c0a.doc_id, hd.h, round(list_dot_product(hd.v, u.v), 6) as s from c0a join hd using (query_id) join u using (doc_id)), x as (select *, exp(4 * (s - max(s) over w)) as x from s window w as (partition by query_id, doc_id)) select query_id, doc_id, round(sum(x * s) / sum(x), 6) as score from x group by 1, 2")
def attention_score(spark, sf):
    """The heads' scores of each of the twenty best, weighted by their softmax over the heads at 4."""
    pool = R.dense(spark, sf, 20).select("query_id", "doc_id")
    s = pool.join(R.heads(spark, sf).withColumnRenamed("vec", "hv"), "query_id").join(units(spark, sf), "doc_id").select("query_id", "doc_id", F.round(dot(F.col("hv"), F.col("vec")), 6).alias("s"))
    x = s.withColumn("x", F.exp(4 * (F.col("s") - F.max("s").over(W.partitionBy("query_id", "doc_id")))))
    return x.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("x") * F.col("s")) / F.sum("x"), 6).alias("score"))


@query("signal_matrix", f"with {R.BOTH}, {R.CHAIN}, {_OFFSET}, p as (select query_id, doc_id from dense where rnk <= 10 union select query_id, doc_id from sgn where rnk <= 10) select p.query_id, p.doc_id, round(list_dot_product(a.v, b.v), 6) as cosine, round(list_dot_product(mv.v, b.v) / sqrt(list_dot_product(mv.v, mv.v)), 6) as moved, coalesce(d.rnk, 101) as dense_rank, coalesce(s.rnk, 101) as sign_rank from p join u a on a.doc_id = p.query_id join u b on b.doc_id = p.doc_id join mv on mv.query_id = p.query_id left join dense d on d.query_id = p.query_id and d.doc_id = p.doc_id left join sgn s on s.query_id = p.query_id and s.doc_id = p.doc_id")
def signal_matrix(spark, sf):
    """Candidates of two lists with their signals: cosine, cosine to the moved query, both ranks."""
    d, s = R.dense(spark, sf).select("query_id", "doc_id", "rnk"), R.signs(spark, sf).select("query_id", "doc_id", "rnk")
    p = d.where("rnk <= 10").unionByName(s.where("rnk <= 10")).select("query_id", "doc_id").distinct()
    moved = R.asked(spark, sf).join(partition.small(offsets(spark, sf)), "pid").select("query_id", unit(F.zip_with(unit(F.col("vec")), "o", lambda a, b: a + b)).alias("mv"))
    x = R.scored(spark, sf, p).withColumnRenamed("score", "cosine").join(moved, "query_id").join(units(spark, sf), "doc_id")
    x = x.withColumn("moved", F.round(dot(F.col("mv"), F.col("vec")), 6))
    x = x.join(d.withColumnRenamed("rnk", "a"), ["query_id", "doc_id"], "left").join(s.withColumnRenamed("rnk", "b"), ["query_id", "doc_id"], "left")
    return x.select("query_id", "doc_id", "cosine", "moved", F.coalesce("a", F.lit(101)).alias("dense_rank"), F.coalesce("b", F.lit(101)).alias("sign_rank"))


@query("routing_features", f"with {R.DENSE}, nb as (select d.query_id, i, avg(u.v[i]) as x from dense d join u using (doc_id), range(1, 65) r(i) where d.rnk <= 10 group by 1, 2), sd as (select d.query_id, u.v from dense d join u using (doc_id) where d.rnk = 1) select query_id, (i - 1)::BIGINT as d, round(x, 6) as x from (select doc_id as query_id, i, v[i] as x from u, range(1, 65) r(i) where doc_id % 100 = 0 union all select query_id, 64 + i, v[i] from sd, range(1, 65) r(i) union all select query_id, 128 + i, x from nb)")
def routing_features(spark, sf):
    """A query's features: its vector, its best hit's and the mean of its ten best's, end to end."""
    d, it = R.dense(spark, sf, 10).select("query_id", "doc_id", "rnk"), units(spark, sf)
    own = R.asked(spark, sf).select("query_id", F.posexplode(unit(F.col("vec"))).alias("d", "x"))
    hit = d.join(it, "doc_id").select("query_id", "rnk", F.posexplode("vec").alias("d", "x"))
    first = hit.where("rnk = 1").select("query_id", F.col("d") + 64, "x")
    mean = hit.groupBy("query_id", "d").agg(F.avg("x").alias("x")).select("query_id", F.col("d") + 128, "x")
    return own.union(first).union(mean).select("query_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))
