"""Vector retrieval, fusion, votes, partitions and their metrics over ``embeddings``.

The corpus is every vector, a partition is a label, and queries are the vectors whose id is
divisible by 100, searched against all others. The golds of a query are the five vectors of its
label that are nearest by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import BLOCK, dot, rank_of, ranked, topk, topk_heads, unit
from evigraph.operators import fusion, graph, metrics, partition
from evigraph.plans.registry import query
from evigraph.session import cut
from evigraph.sources.tables import table

K = 100


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("pid"), F.col("embedding").alias("vec"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "pid", "vec")


def dense(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return topk(asked(spark, sf), items(spark, sf), k, "unit", exclude_self=True)


def signs(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return topk(asked(spark, sf), items(spark, sf), k, "sign", exclude_self=True)


def golds(spark: SparkSession, sf: str) -> DataFrame:
    """Per label, the two neighbours by id on either side are found by windows over the label."""
    it = items(spark, sf).select("doc_id", "pid")
    w = W.partitionBy("pid").orderBy("doc_id")
    near = it.select("doc_id", F.array(*[F.lag("doc_id", i).over(w) for i in range(1, 6)], *[F.lead("doc_id", i).over(w) for i in range(1, 6)]).alias("n"))
    near = near.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode("n").alias("doc_id")).where("doc_id is not null")
    w2 = W.partitionBy("query_id").orderBy(F.abs(F.col("doc_id") - F.col("query_id")), "doc_id")
    return near.withColumn("r", F.row_number().over(w2)).where("r <= 5").select("query_id", "doc_id")


def lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"dense": dense(spark, sf), "sign": signs(spark, sf)}


def hard(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("doc_id", "pid")


def chain_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.chain(hard(spark, sf), "pid", "doc_id")


# --- DuckDB equivalents: common table expressions -------------------------------------------------
E = "e as (select vec_id as doc_id, label::BIGINT as pid, embedding::DOUBLE[] as v from embeddings)"
U = E + ", u as (select doc_id, pid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e)"
RANK = "row_number() over (partition by query_id order by score desc, doc_id)"


def _list(name: str, src: str, k: int = K) -> str:
    return f"""{name}_s as (select a.doc_id as query_id, b.doc_id, round(list_dot_product(a.v, b.v), 6) as score from {src} a, {src} b where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id),
    {name} as (select * from (select query_id, {RANK} as rnk, doc_id, score from {name}_s) where rnk <= {k})"""


DENSE = U + ", " + _list("dense", "u")
SIGN = "g as (select doc_id, pid, list_transform(v, lambda x: sign(x)::DOUBLE) as v from e), " + _list("sgn", "g")
BOTH = DENSE + ", " + SIGN
GOLD = """gold as (select query_id, doc_id from (select a.doc_id as query_id, b.doc_id, row_number() over (partition by a.doc_id order by abs(b.doc_id - a.doc_id), b.doc_id) as r
    from e a join e b on a.pid = b.pid and a.doc_id <> b.doc_id where a.doc_id % 100 = 0) where r <= 5)"""
CHAIN = "ch as (select * from (select lag(doc_id) over (partition by pid order by doc_id) as src, doc_id as dst from e) where src is not null)"
MIRROR = CHAIN + ", ed as (select src, dst from ch union select dst, src from ch)"
HALL = "select * from (select 'dense' as list, * from dense union all select 'sign', * from sgn)"


@query("dense_topk", f"with {DENSE} select query_id, rnk, doc_id, score from dense")
def dense_topk(spark, sf):
    return dense(spark, sf)


@query("sign_topk", f"with {E}, {SIGN} select query_id, rnk, doc_id, score from sgn")
def sign_topk(spark, sf):
    return signs(spark, sf)


CENTROID = """c0 as (select pid, i as d, avg(v[i]) as x from e, range(1, 65) r(i) group by pid, i),
    c as (select pid, list(x / l order by d) as v from (select *, sqrt(sum(x * x) over (partition by pid)) as l from c0) group by pid)"""


@query("centroids_plain", f"with {E}, {CENTROID} select pid, i as d, round(v[i], 6) as x from c, range(1, 65) r(i)")
def centroids_plain(spark, sf):
    c = partition.centroids(items(spark, sf))
    return c.select("pid", F.posexplode("vec").alias("d", "x")).select("pid", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"))


WC = MIRROR + """, dg as (select src as doc_id, count(*) as degree from ed group by src),
    wc0 as (select pid, i as d, sum((coalesce(degree, 0) + 1) * v[i]) as x from e left join dg using (doc_id), range(1, 65) r(i) group by pid, i),
    wc as (select pid, list(x / l order by d) as v from (select *, sqrt(sum(x * x) over (partition by pid)) as l from wc0) group by pid)"""


@query("centroids_weighted", f"with {E}, {WC} select pid, i as d, round(v[i], 6) as x from wc, range(1, 65) r(i)")
def centroids_weighted(spark, sf):
    deg = graph.degrees(graph.mirror(chain_edges(spark, sf)))
    c = partition.centroids(items(spark, sf), deg)
    return c.select("pid", F.posexplode("vec").alias("d", "x")).select("pid", (F.col("d") + 1).cast("long").alias("d"), F.round("x", 6).alias("x"))


ROUTED = CENTROID + """, ro as (select query_id, pid, score, row_number() over (partition by query_id order by score desc, pid) as rnk
    from (select u.doc_id as query_id, c.pid, round(list_dot_product(u.v, c.v), 6) as score from u, c where u.doc_id % 100 = 0))"""


def routed(spark, sf, k: int = 10) -> DataFrame:
    cents = partition.centroids(items(spark, sf)).select(F.col("pid").alias("doc_id"), "vec")
    q = asked(spark, sf).withColumn("vec", unit(F.col("vec")))
    return topk(q, cents, k).select("query_id", F.col("doc_id").alias("pid"), "score", "rnk")


@query("centroid_topk", f"with {U}, {ROUTED} select query_id, pid, score, rnk from ro")
def centroid_topk(spark, sf):
    return routed(spark, sf)


@query("centroid_nearest_docs", f"with {U}, {CENTROID}, s as (select u.doc_id, c.pid, round(list_dot_product(u.v, c.v), 6) as score from u, c) select doc_id, pid, score from (select *, row_number() over (partition by doc_id order by score desc, pid) as r from s) where r <= 2")
def centroid_nearest_docs(spark, sf):
    """Membership by the two nearest centroids of every document; centroids are few by nature."""
    return member_knn(spark, sf)


def member_knn(spark, sf, m: int = 2) -> DataFrame:
    from evigraph.functions.vector import _matrix, _shape  # noqa: PLC2701

    import numpy as np
    import pyarrow as pa

    got = partition.held_centroids(partition.centroids(items(spark, sf)))
    held = spark.sparkContext.broadcast((got.column("pid").to_numpy(), _matrix(got.column("vec"))))

    def run(batches):
        pids, c = held.value
        for batch in batches:
            if batch.num_rows:
                s = np.round(_shape(_matrix(batch.column(1).cast(pa.list_(pa.float64()))), "unit") @ c.T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(pids, s.shape), -s), axis=1)[:, :m]
                r = np.repeat(np.arange(len(s)), order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(pids[order.ravel()]), pa.array(s[r, order.ravel()])], names=["doc_id", "pid", "score"])

    return items(spark, sf).select("doc_id", "vec").mapInArrow(run, "doc_id long, pid long, score double")


SCOPED = """sc as (select query_id, rnk, doc_id, score from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rnk from
    (select ro.query_id, b.doc_id, round(list_dot_product(a.v, b.v), 6) as score from ro join u a on a.doc_id = ro.query_id join u b on b.pid = ro.pid where ro.rnk <= 3)) where rnk <= 50)"""


@query("scoped_dense", f"with {U}, {ROUTED}, {SCOPED} select * from sc")
def scoped_dense(spark, sf):
    it = items(spark, sf).withColumn("vec", unit(F.col("vec")))
    q = asked(spark, sf).withColumn("vec", unit(F.col("vec")))
    return partition.scoped(q, routed(spark, sf, 3), it, 50)


HEADS = "hd as (select query_id, h, v from (select doc_id as query_id, 0 as h, v from u where doc_id % 100 = 0 union all select u.doc_id, ro.rnk, list_transform(list_zip(u.v, c.v), lambda z: (z[1] + z[2])) from u join ro on ro.query_id = u.doc_id and ro.rnk <= 2 join c on c.pid = ro.pid))"


def heads(spark, sf) -> DataFrame:
    """A query's positions: itself, and itself moved towards each of its two nearest centroids."""
    q = asked(spark, sf).select("query_id", unit(F.col("vec")).alias("vec"))
    c = partition.centroids(items(spark, sf)).select("pid", F.col("vec").alias("cv"))
    moved = routed(spark, sf, 2).join(partition.small(c), "pid").join(q, "query_id").select("query_id", F.col("rnk").cast("long").alias("h"), F.zip_with("vec", "cv", lambda a, b: a + b).alias("vec"))
    return q.select("query_id", F.lit(0).cast("long").alias("h"), "vec").unionByName(moved)


@query("multi_head_max", f"with {U}, {ROUTED}, {HEADS}, s as (select query_id, doc_id, max(round(list_dot_product(hd.v, u.v), 6)) as score from hd, u group by query_id, doc_id) select * from (select query_id, {RANK} as rnk, doc_id, score from s) where rnk <= 50")
def multi_head_max(spark, sf):
    return topk_heads(heads(spark, sf), items(spark, sf).withColumn("vec", unit(F.col("vec"))), 50)


@query("multi_head_softor", f"with {U}, {ROUTED}, {HEADS}, s0 as (select query_id, doc_id, round(list_dot_product(hd.v, u.v), 6) as x from hd, u), s as (select query_id, doc_id, round(max(x) + 0.05 * ln(sum(exp((x - m) / 0.05))), 6) as score from (select *, max(x) over (partition by query_id, doc_id) as m from s0) group by query_id, doc_id) select * from (select query_id, {RANK} as rnk, doc_id, score from s) where rnk <= 50")
def multi_head_softor(spark, sf):
    """Soft-or of the heads, tau 0.05: max + tau ln sum exp((x - max) / tau)."""
    return topk_heads(heads(spark, sf), items(spark, sf).withColumn("vec", unit(F.col("vec"))), 50, tau=0.05)


PRF = f"""t1 as (select query_id, doc_id from dense where rnk = 1), pq as (select t1.query_id, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) as v from t1 join u a on a.doc_id = t1.query_id join u b on b.doc_id = t1.doc_id),
    prf as (select * from (select query_id, {RANK} as rnk, doc_id, score from (select pq.query_id, u.doc_id, round(list_dot_product(pq.v, u.v) / sqrt(list_dot_product(pq.v, pq.v)), 6) as score from pq, u where u.doc_id <> pq.query_id)) where rnk <= {K}),
    prfr as (select query_id, doc_id, round(sum(1.0 / (60 + rnk)), 9) as score from (select * from dense union all select * from prf) group by query_id, doc_id)"""


@query("prf_rrf", f"with {DENSE}, {PRF} select * from (select query_id, {RANK} as rnk, doc_id, score from prfr) where rnk <= 50")
def prf_rrf(spark, sf):
    """Pseudo-relevance feedback: the query plus its best hit is searched again, both lists fused."""
    d = dense(spark, sf)
    it = items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec"))
    first = d.where("rnk = 1").select("query_id", "doc_id").join(it, "doc_id")
    q = asked(spark, sf).select("query_id", unit(F.col("vec")).alias("qv")).join(first, "query_id")
    moved = q.select("query_id", unit(F.zip_with("qv", "vec", lambda a, b: a + b)).alias("vec"))
    again = topk(moved, it, K, exclude_self=True)
    return fusion.rrf({"a": d, "b": again}, 50)


def _rrf(base: int, w: str = "1.0") -> str:
    return f"select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, round(sum({w} / (60 + rnk - 1 + {base})), 9) as score from ({HALL}) group by query_id, doc_id)"


@query("rrf0", f"with {BOTH} {_rrf(0)}")
def rrf0(spark, sf):
    return fusion.rrf(lists(spark, sf), base=0)


@query("rrf1_weighted", f"with {BOTH} {_rrf(1, chr(39).join(['(case when list = ', 'dense', ' then 1.0 else 4.0 end)']))}")
def rrf1_weighted(spark, sf):
    return fusion.rrf(lists(spark, sf), base=1, weights={"dense": 1.0, "sign": 4.0})


@query("minrank", f"with {BOTH} select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, (-min(rnk))::DOUBLE as score from ({HALL}) group by query_id, doc_id)")
def minrank(spark, sf):
    return fusion.min_rank(lists(spark, sf))


@query("anchored", f"""with {BOTH}, f as ({_rrf(1)}), t as (select query_id, doc_id, min(struct_pack(t := 0, r := rnk)) as p from dense where rnk <= 10 group by all union all select query_id, doc_id, struct_pack(t := 1, r := rnk) from f),
    b as (select query_id, doc_id, min(p) as p from t group by query_id, doc_id) select * from (select query_id, row_number() over (partition by query_id order by p.t, p.r, doc_id) as rnk, doc_id, p.t::BIGINT as tier from b) where rnk <= 50""")
def anchored(spark, sf):
    own = lists(spark, sf)
    return fusion.tiers([(own["dense"], 10), (fusion.rrf(own), None)], 50)


@query("head_compose", f"""with {BOTH}, f as (select query_id, {RANK} as rnk, doc_id from (select query_id, doc_id, -min(rnk) as score from ({HALL}) group by query_id, doc_id)), t as (select query_id, doc_id, struct_pack(t := 0, r := rnk) as p from sgn where rnk <= 20 union all select query_id, doc_id, struct_pack(t := 1, r := rnk) from f),
    b as (select query_id, doc_id, min(p) as p from t group by query_id, doc_id) select * from (select query_id, row_number() over (partition by query_id order by p.t, p.r, doc_id) as rnk, doc_id, p.t::BIGINT as tier from b) where rnk <= 50""")
def head_compose(spark, sf):
    own = lists(spark, sf)
    return fusion.tiers([(own["sign"], 20), (fusion.min_rank(own), None)], 50)


@query("combsum", f"with {BOTH} select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, round(sum(case when list = 'dense' then 1.0 else 0.01 end * score), 6) as score from ({HALL}) group by query_id, doc_id)")
def combsum(spark, sf):
    return fusion.combsum(lists(spark, sf), {"dense": 1.0, "sign": 0.01})


Z = f"z as (select list, query_id, doc_id, case when stddev_pop(score) over w > 0 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end as score from ({HALL}) window w as (partition by list, query_id))"


@query("zscore_sum", f"with {BOTH}, {Z} select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, round(sum(score), 6) as score from z group by query_id, doc_id)")
def zscore_sum(spark, sf):
    return fusion.zfuse(lists(spark, sf))


@query("zscore_max", f"with {BOTH}, {Z} select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, round(max(score), 6) as score from z group by query_id, doc_id)")
def zscore_max(spark, sf):
    return fusion.zfuse(lists(spark, sf), "max")


@query("hybrid_z", f"with {BOTH}, {Z} select query_id, {RANK} as rnk, doc_id, score from (select query_id, doc_id, round(sum(score) - 5.0 * (2 - count(distinct list)), 6) as score from z group by query_id, doc_id)")
def hybrid_z(spark, sf):
    return fusion.zfuse(lists(spark, sf), absent=-5.0)


@query("seed_minmax", f"with {DENSE} select query_id, rnk, doc_id, round(case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1 end, 6) as score from dense window w as (partition by query_id)")
def seed_minmax(spark, sf):
    return fusion.minmax(dense(spark, sf)).withColumn("score", F.round("score", 6))


@query("round_robin", f"""with {BOTH}, b as (select query_id, doc_id, min(struct_pack(r := rnk, o := case when list = 'dense' then 0 else 1 end)) as p from ({HALL}) group by query_id, doc_id)
    select * from (select query_id, row_number() over (partition by query_id order by p.r, p.o, doc_id) as rnk, doc_id from b) where rnk <= 40""")
def round_robin(spark, sf):
    return fusion.round_robin(lists(spark, sf), 40)


@query("list_overlap", f"with {BOTH} select d.query_id, round(count(s.doc_id) / 20.0, 6) as overlap from (select * from dense where rnk <= 20) d left join (select * from sgn where rnk <= 20) s using (query_id, doc_id) group by d.query_id")
def list_overlap(spark, sf):
    own = lists(spark, sf)
    return fusion.overlap(own["dense"], own["sign"], 20)


@query("overlap_attribution", f"""with {BOTH}, {GOLD} select case when d.doc_id is not null and s.doc_id is not null then 'both' when d.doc_id is not null then 'dense_only' when s.doc_id is not null then 'sign_only' else 'neither' end as found_by, count(*)::BIGINT as golds
    from gold left join dense d using (query_id, doc_id) left join sgn s using (query_id, doc_id) group by 1""")
def overlap_attribution(spark, sf):
    g, d, s = golds(spark, sf), dense(spark, sf), signs(spark, sf)
    j = g.join(d.select("query_id", "doc_id", F.lit(1).alias("d")), ["query_id", "doc_id"], "left").join(s.select("query_id", "doc_id", F.lit(1).alias("s")), ["query_id", "doc_id"], "left")
    by = F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), "both").when(F.col("d").isNotNull(), "dense_only").when(F.col("s").isNotNull(), "sign_only").otherwise("neither")
    return j.groupBy(by.alias("found_by")).agg(F.count(F.lit(1)).alias("golds"))


SPECS = [("dense", 1.0, 0.0), ("even", 1.0, 1.0), ("sign_heavy", 1.0, 4.0), ("dense_heavy", 4.0, 1.0)]
_SPEC_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SPECS)


@query("fusion_spec_select", f"""with {BOTH}, {GOLD}, sp(spec, wd, ws) as (values {_SPEC_VALUES}), f as (select spec, query_id, doc_id, round(sum(case when list = 'dense' then wd else ws end / (60 + rnk)), 9) as score from sp, ({HALL}) group by all),
    r as (select *, row_number() over (partition by spec, query_id order by score desc, doc_id) as rnk from f), h as (select sp.spec, g.query_id, avg(case when r.rnk <= 100 then 1.0 else 0 end) as rec, min(case when r.rnk <= 100 then 1 else 0 end) as cov from sp cross join gold g left join r on r.spec = sp.spec and r.query_id = g.query_id and r.doc_id = g.doc_id group by sp.spec, g.query_id)
    select spec, round(avg(cov), 6) as full_100, round(avg(rec), 6) as recall_100, row_number() over (order by round(avg(cov), 6) desc, round(avg(rec), 6) desc, spec) as place from h group by spec""")
def fusion_spec_select(spark, sf):
    """A grid of fusion weights, ordered by full coverage, then recall, then name."""
    own, g = lists(spark, sf), golds(spark, sf)
    out = None
    for name, a, b in SPECS:
        r = fusion.rrf(own, 100, weights={"dense": a, "sign": b})
        m = metrics.per_query(r, g, [100]).agg(F.round(F.avg("full_100"), 6).alias("full_100"), F.round(F.avg("recall_100"), 6).alias("recall_100")).select(F.lit(name).alias("spec"), "*")
        out = m if out is None else out.unionByName(m)
    return out.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.desc("full_100"), F.desc("recall_100"), "spec")).cast("long"))


# --- votes and routing ----------------------------------------------------------------------------
V = "{0} as (select query_id, pid, round({1}, 9) as score from dense join e using (doc_id) group by query_id, pid)"
for _name, _how, _agg in (("vote_count", "count", "sum(1.0::DOUBLE)"), ("vote_rr_sum", "sum", "sum(1.0 / (59 + rnk))"), ("vote_rr_max", "max", "max(1.0 / (59 + rnk))")):
    query(_name, f"with {DENSE}, {V.format('v', _agg)} select * from v")(lambda spark, sf, how=_how: fusion.votes(dense(spark, sf), hard(spark, sf), how))


def _order_sql(name: str, src: str) -> str:
    return f"""{name} as (select query_id, pid, rnk, round(1.0 / (59 + rnk), 9) as rr from (select q.query_id, p.pid, row_number() over (partition by q.query_id order by coalesce(s.score, 0) desc, p.pid) as rnk
    from (select distinct query_id from {src}) q cross join (select distinct pid from e) p left join {src} s on s.query_id = q.query_id and s.pid = p.pid))"""


ROUTE = f"{V.format('vs', 'sum(1.0 / (59 + rnk))')}, {V.format('vm', 'max(1.0 / (59 + rnk))')}, {_order_sql('os', 'vs')}, {_order_sql('om', 'vm')}, rt as (select query_id, pid, round(os.rr + om.rr, 9) as score, row_number() over (partition by query_id order by round(os.rr + om.rr, 9) desc, pid) as rnk from os join om using (query_id, pid))"


def scored(spark, sf, pairs: DataFrame) -> DataFrame:
    """Pairs ``(query_id, doc_id, ...)`` with their cosine."""
    it = items(spark, sf).select("doc_id", unit(F.col("vec")).alias("vec"))
    q = asked(spark, sf).select("query_id", unit(F.col("vec")).alias("qv"))
    return pairs.join(q, "query_id").join(it, "doc_id").withColumn("score", F.round(dot(F.col("qv"), F.col("vec")), 6)).drop("qv", "vec")


def in_partitions(spark, sf, routed: DataFrame, each: int) -> DataFrame:
    """The ``each`` best documents of every routed partition, scored inside it; a query is none."""
    it = items(spark, sf).withColumn("vec", unit(F.col("vec")))
    q = asked(spark, sf).withColumn("vec", unit(F.col("vec")))
    s = partition.scoped(q, routed, it, each + 1, each=True).where("doc_id <> query_id")
    w = W.partitionBy("query_id", "pid").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).drop("r")


def vote_order(spark, sf, membership: DataFrame | None = None) -> DataFrame:
    d, m = dense(spark, sf), membership if membership is not None else hard(spark, sf)
    pids = hard(spark, sf).select("pid").distinct()
    a = fusion.route_order(fusion.votes(d, m, "sum"), pids).select("query_id", "pid", F.col("rr").alias("a"))
    b = fusion.route_order(fusion.votes(d, m, "max"), pids).select("query_id", "pid", F.col("rr").alias("b"))
    s = a.join(b, ["query_id", "pid"]).select("query_id", "pid", F.round(F.col("a") + F.col("b"), 9).alias("score"))
    return s.withColumn("rnk", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pid")).cast("long"))


@query("vote_route", f"with {DENSE}, {ROUTE} select query_id, pid, score, rnk from rt")
def vote_route(spark, sf):
    return vote_order(spark, sf)


@query("vote_idf", f"with {DENSE}, fr as (select pid, count(*) as f, (select count(*) from e) as n from e group by pid) select query_id, pid, round(sum(1.0::DOUBLE), 6) as plain, round(sum(ln(1 + n / f)), 6) as log1p, round(sum(sqrt(n / f)), 6) as root, round(sum(n / f), 6) as linear from dense join e using (doc_id) join fr using (pid) group by query_id, pid")
def vote_idf(spark, sf):
    h = hard(spark, sf)
    n = h.agg(F.count(F.lit(1)).alias("n"))
    fr = h.groupBy("pid").agg(F.count(F.lit(1)).alias("f")).crossJoin(F.broadcast(n)).select("pid", (F.col("n") / F.col("f")).alias("x"))
    j = dense(spark, sf).join(h, "doc_id").join(fr, "pid")
    return j.groupBy("query_id", "pid").agg(F.round(F.sum(F.lit(1.0)), 6).alias("plain"), F.round(F.sum(F.log1p("x")), 6).alias("log1p"), F.round(F.sum(F.sqrt("x")), 6).alias("root"), F.round(F.sum("x"), 6).alias("linear"))


@query("partition_quota", f"""with {DENSE}, {ROUTE}, o as (select d.query_id, d.doc_id, rt.rnk as pr, row_number() over (partition by d.query_id, rt.pid order by d.score desc, d.doc_id) as dr from dense_s d join e using (doc_id) join rt on rt.query_id = d.query_id and rt.pid = e.pid where rt.rnk <= 5)
    select * from (select query_id, row_number() over (partition by query_id order by dr, pr, doc_id) as rnk, doc_id from o where dr <= 5) where rnk <= 100""")
def partition_quota(spark, sf):
    order = cut(vote_order(spark, sf))  # ids and ranks, used twice
    return partition.quota(order, in_partitions(spark, sf, order.where("rnk <= 5"), 5), hard(spark, sf), 5, 5, 100)


@query("route_fill", f"""with {DENSE}, {ROUTE}, o as (select d.query_id, d.doc_id, rt.rnk as pr, row_number() over (partition by d.query_id, rt.pid order by d.score desc, d.doc_id) as dr from dense_s d join e using (doc_id) join rt on rt.query_id = d.query_id and rt.pid = e.pid where rt.rnk <= 3),
    a as (select query_id, doc_id, row_number() over (partition by query_id order by dr, pr, doc_id) as r, 0 as t from o where dr <= 5), t as (select query_id, doc_id, min(struct_pack(t := t, r := r)) as p from (select query_id, doc_id, r, t from a union all select query_id, doc_id, rnk, 1 from dense) group by query_id, doc_id)
    select * from (select query_id, row_number() over (partition by query_id order by p.t, p.r, doc_id) as rnk, doc_id, p.t::BIGINT as tier from t) where rnk <= 50""")
def route_fill(spark, sf):
    order = cut(vote_order(spark, sf))
    head = partition.quota(order, in_partitions(spark, sf, order.where("rnk <= 3"), 5), hard(spark, sf), 3, 5, 100)
    return fusion.tiers([(head, None), (dense(spark, sf), None)], 50)


@query("pool_stats", f"with {DENSE}, {ROUTE}, z as (select pid, count(*) as n from e group by pid) select b.budget::BIGINT as budget, rt.query_id, sum(n)::BIGINT as pool, round(1 - sum(n) / (select count(*) from e), 6) as reduction from rt join z using (pid), (values (1), (3), (5)) b(budget) where rt.rnk <= b.budget group by 1, 2")
def pool_stats(spark, sf):
    h = hard(spark, sf)
    z = h.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.count(F.lit(1)).alias("total"))
    r = vote_order(spark, sf).join(z, "pid").withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in (1, 3, 5)]))).where("rnk <= budget")
    return r.groupBy("budget", "query_id").agg(F.sum("n").alias("pool")).crossJoin(F.broadcast(total)).select("budget", "query_id", "pool", F.round(1 - F.col("pool") / F.col("total"), 6).alias("reduction"))


# --- memberships ----------------------------------------------------------------------------------
@query("member_hard", f"with {E} select doc_id, pid from e")
def member_hard(spark, sf):
    return hard(spark, sf)


LINKS = "lk as (select doc_id as src, doc_id + 1 as dst from e where doc_id + 1 in (select doc_id from e)), lm as (select src, dst from lk union select dst, src from lk)"


def id_links(spark, sf) -> DataFrame:
    """Edges between vectors of consecutive ids: they cross partitions."""
    it = hard(spark, sf).select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return graph.mirror(it.join(hard(spark, sf).select(F.col("doc_id").alias("dst")), "dst", "left_semi"))


ONEHOP = LINKS + ", m1 as (select doc_id, pid from e union select lm.src, e.pid from lm join e on e.doc_id = lm.dst)"


@query("member_onehop", f"with {E}, {ONEHOP} select * from m1")
def member_onehop(spark, sf):
    return partition.onehop(hard(spark, sf), id_links(spark, sf))


@query("member_twohop", f"with {E}, {ONEHOP} select * from m1 union select lm.src, m1.pid from lm join m1 on m1.doc_id = lm.dst")
def member_twohop(spark, sf):
    return partition.twohop(hard(spark, sf), id_links(spark, sf))


@query("pool_explosion", f"with {E}, {ONEHOP} select pid, h.n as hard, m.n as pool, round(m.n / h.n, 6) as factor from (select pid, count(*) as n from m1 group by pid) m join (select pid, count(*) as n from e group by pid) h using (pid)")
def pool_explosion(spark, sf):
    return partition.explosion(hard(spark, sf), member_onehop(spark, sf))


@query("fullcov_overlap", f"""with {DENSE}, {ROUTE}, {GOLD}, {ONEHOP}, b as (select g.query_id, g.doc_id, min(rt.rnk) as rnk from gold g join m1 using (doc_id) left join rt on rt.query_id = g.query_id and rt.pid = m1.pid group by 1, 2)
    select query_id, min((coalesce(rnk, 999) <= 1)::INT) as full_1, round(avg((coalesce(rnk, 999) <= 1)::INT), 6) as recall_1, min((coalesce(rnk, 999) <= 3)::INT) as full_3, round(avg((coalesce(rnk, 999) <= 3)::INT), 6) as recall_3 from b group by query_id""")
def fullcov_overlap(spark, sf):
    return metrics.partition_coverage(vote_order(spark, sf), member_onehop(spark, sf), golds(spark, sf), [1, 3])


@query("bucket_inflation", f"""with {DENSE}, {ROUTE}, {GOLD}, {ONEHOP}, x as (select g.query_id, g.doc_id, min(case when m.k = 0 then rt.rnk end) as h, min(rt.rnk) as o from gold g join (select doc_id, pid, 0 as k from e union all select doc_id, pid, 1 from m1) m using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = m.pid group by 1, 2),
    q as (select query_id, min((h <= 3)::INT) as fh, min((o <= 3)::INT) as fo from x group by 1) select round(avg(fh), 6) as hard, round(avg(fo), 6) as overlapped, round(avg(fo) - avg(fh), 6) as inflation from q""")
def bucket_inflation(spark, sf):
    order, g = vote_order(spark, sf), golds(spark, sf)
    a = metrics.partition_coverage(order, hard(spark, sf), g, [3]).select("query_id", F.col("full_3").alias("h"))
    b = metrics.partition_coverage(order, member_onehop(spark, sf), g, [3]).select("query_id", F.col("full_3").alias("o"))
    return a.join(b, "query_id").agg(F.round(F.avg("h"), 6).alias("hard"), F.round(F.avg("o"), 6).alias("overlapped"), F.round(F.avg("o") - F.avg("h"), 6).alias("inflation"))


@query("candgen_matched", f"""with {DENSE}, {ROUTE}, {GOLD}, z as (select pid, count(*) as n from e group by pid), pool as (select query_id, sum(n) as k from rt join z using (pid) where rnk <= 3 group by 1), al as (select query_id, doc_id, {RANK} as rnk from dense_s)
    select g.query_id, any_value(pool.k)::BIGINT as pool, round(avg((rt.rnk <= 3)::INT), 6) as partition_recall, round(avg((al.rnk <= pool.k)::INT), 6) as dense_recall, round(avg((rt.rnk <= 3)::INT) - avg((al.rnk <= pool.k)::INT), 6) as gap
    from gold g join e using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid join pool on pool.query_id = g.query_id join al on al.query_id = g.query_id and al.doc_id = g.doc_id group by g.query_id""")
def candgen_matched(spark, sf):
    """A partition pool against as many dense candidates: per query, k is the size of its pool."""
    h, order = hard(spark, sf), vote_order(spark, sf)
    z = h.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    pool = order.where("rnk <= 3").join(z, "pid").groupBy("query_id").agg(F.sum("n").alias("pool"))
    every = rank_of(asked(spark, sf), items(spark, sf), golds(spark, sf)).withColumnRenamed("rnk", "dr")
    j = golds(spark, sf).join(h, "doc_id").join(order.select("query_id", "pid", "rnk"), ["query_id", "pid"]).join(pool, "query_id").join(every, ["query_id", "doc_id"])
    p, d = (F.col("rnk") <= 3).cast("double"), (F.col("dr") <= F.col("pool")).cast("double")
    return j.groupBy("query_id").agg(F.first("pool").alias("pool"), F.round(F.avg(p), 6).alias("partition_recall"), F.round(F.avg(d), 6).alias("dense_recall"), F.round(F.avg(p) - F.avg(d), 6).alias("gap"))


@query("champion_interp", f"""with {DENSE}, {ROUTE}, {GOLD}, z as (select pid, count(*) as n from e group by pid), c as (select rt.query_id, rt.pid, rt.rnk, sum(n) over (partition by rt.query_id order by rt.rnk) / (select count(*) from e) as frac from rt join z using (pid)),
    w as (select g.query_id, max(rt.rnk) as worst from gold g join e using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid group by 1), pt as (select c.rnk, round(avg(frac), 9) as x, round(avg((w.worst <= c.rnk)::INT), 9) as y from c join w using (query_id) group by 1),
    pl(a) as (values (0.1), (0.25), (0.5), (1.0)), lo as (select a, max(struct_pack(x := x, y := y)) as p from pl join pt on x <= a group by a), hi as (select a, min(struct_pack(x := x, y := y)) as p from pl join pt on x >= a group by a)
    select pl.a::DOUBLE as x, round(case when coalesce(hi.p, lo.p).x = coalesce(lo.p, hi.p).x then coalesce(lo.p, hi.p).y else coalesce(lo.p, hi.p).y + (coalesce(hi.p, lo.p).y - coalesce(lo.p, hi.p).y) * (pl.a::DOUBLE - coalesce(lo.p, hi.p).x) / (coalesce(hi.p, lo.p).x - coalesce(lo.p, hi.p).x) end, 6) as y from pl left join lo using (a) left join hi using (a)""")
def champion_interp(spark, sf):
    """Full coverage as a function of the pool's share of the corpus, read off at fixed shares."""
    from evigraph.functions.stats import interpolate

    h, order = hard(spark, sf), vote_order(spark, sf)
    total = h.agg(F.count(F.lit(1)).alias("total"))
    z = h.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    frac = F.sum("n").over(W.partitionBy("query_id").orderBy("rnk").rowsBetween(W.unboundedPreceding, 0)) / F.col("total")
    c = order.join(z, "pid").crossJoin(F.broadcast(total)).select("query_id", "rnk", frac.alias("frac"))
    worst = golds(spark, sf).join(h, "doc_id").join(order.select("query_id", "pid", "rnk"), ["query_id", "pid"]).groupBy("query_id").agg(F.max("rnk").alias("worst"))
    pts = c.join(worst, "query_id").groupBy("rnk").agg(F.round(F.avg("frac"), 9).alias("x"), F.round(F.avg((F.col("worst") <= F.col("rnk")).cast("double")), 9).alias("y"))
    return interpolate(pts, "x", "y", [0.1, 0.25, 0.5, 1.0]).withColumn("y", F.round("y", 6))


# --- metrics --------------------------------------------------------------------------------------
def _metrics_sql(rank_src: str, ks: list[int], by_list: bool, sentinel: str) -> str:
    parts = []
    for k in ks:
        h = f"count(*) filter (where rnk <= {k})"
        den = f"greatest(least({k}, any_value(n)), 1)" if by_list else str(k)
        idcg = f"list_sum(list_transform(range(1, least(count(*), {k})::BIGINT + 1), lambda i: 1.0 / log2(i + 1)))"
        parts.append(f"""({h} > 0)::INT as hit_{k}, round({h} / count(*), 6) as recall_{k}, ({h} = count(*))::INT as full_{k}, round({h} / {den}, 6) as precision_{k},
        round(case when {h} > 0 then 2 * ({h} / {den}) * ({h} / count(*)) / ({h} / {den} + {h} / count(*)) else 0 end, 6) as f1_{k}, round(coalesce(sum(1.0 / log2(rnk + 1)) filter (where rnk <= {k}), 0) / {idcg}, 6) as ndcg_{k}""")
    return f"""select query_id, count(*)::BIGINT as golds, {', '.join(parts)}, round(coalesce(1.0 / min(rnk), 0), 6) as mrr, max(coalesce(rnk, {sentinel}))::BIGINT as weakest
    from (select g.query_id, g.doc_id, r.rnk, (select max(rnk) from {rank_src} x where x.query_id = g.query_id) as n from gold g left join {rank_src} r using (query_id, doc_id)) group by query_id"""


@query("metrics_doc", f"with {DENSE}, {GOLD} {_metrics_sql('dense', [1, 5, 20, 100], False, 'n + 1')}")
def metrics_doc(spark, sf):
    return metrics.per_query(dense(spark, sf), golds(spark, sf), [1, 5, 20, 100])


@query("metrics_contract", f"with {DENSE}, {GOLD}, d as (select * from dense where rnk <= 7) {_metrics_sql('d', [5, 10], True, 'n + 1')}")
def metrics_contract(spark, sf):
    """The contract's conventions: precision over what is retrieved, misses at length + 1."""
    return metrics.per_query(dense(spark, sf, 7), golds(spark, sf), [5, 10], divide_by_list=True)


@query("metrics_partition", f"""with {DENSE}, {ROUTE}, gold as (select distinct g.query_id, e.pid as doc_id from ({'select query_id, doc_id from (select a.doc_id as query_id, b.doc_id, row_number() over (partition by a.doc_id order by abs(b.doc_id - a.doc_id), b.doc_id) as r from e a join e b on a.doc_id <> b.doc_id where a.doc_id % 100 = 0) where r <= 5'}) g join e using (doc_id)), ro as (select query_id, pid as doc_id, rnk from rt) {_metrics_sql('ro', [1, 3], False, '11')}""")
def metrics_partition(spark, sf):
    """Partition metrics: golds are the partitions of the five vectors nearest by id; the miss
    sentinel is the number of partitions + 1."""
    it = partition.dense_rank_of(hard(spark, sf), "doc_id")
    # the five nearest by id are among the five before and the five after, whatever the gaps
    around = it.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.sequence(F.col("idx") - 5, F.col("idx") + 5)).alias("idx"))
    near = around.join(it, "idx").where("doc_id <> query_id")
    w = W.partitionBy("query_id").orderBy(F.abs(F.col("doc_id") - F.col("query_id")), "doc_id")
    g = near.withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", F.col("pid").alias("doc_id"))
    order = vote_order(spark, sf).select("query_id", F.col("pid").alias("doc_id"), "rnk")
    return metrics.per_query(order, g, [1, 3], sentinel=11)


@query("metrics_grouping_sets", f"with {DENSE}, {GOLD}, m as (select g.query_id, avg((coalesce(d.rnk, 999) <= 20)::INT) as r, min((coalesce(d.rnk, 999) <= 20)::INT) as f from gold g left join dense d using (query_id, doc_id) group by 1) select e.pid, count(*)::BIGINT as queries, round(100 * avg(r), 2) as recall_20, round(100 * avg(f), 2) as full_20 from m join e on e.doc_id = m.query_id group by grouping sets ((e.pid), ())")
def metrics_grouping_sets(spark, sf):
    m = metrics.per_query(dense(spark, sf), golds(spark, sf), [20]).join(asked(spark, sf).select("query_id", "pid"), "query_id")
    return m.rollup("pid").agg(F.count(F.lit(1)).alias("queries"), F.round(100 * F.avg("recall_20"), 2).alias("recall_20"), F.round(100 * F.avg("full_20"), 2).alias("full_20"))


@query("miss_taxonomy", f"""with {DENSE}, {ROUTE}, {GOLD} select case when rt.rnk <= 3 then 'covered' when d.doc_id is null and v.pid is null then 'not_voted' when d.doc_id is null then 'not_retrieved' else 'outranked' end as reason, count(*)::BIGINT as golds
    from gold g join e using (doc_id) join rt on rt.query_id = g.query_id and rt.pid = e.pid left join dense d on d.query_id = g.query_id and d.doc_id = g.doc_id left join vs v on v.query_id = g.query_id and v.pid = e.pid group by 1""")
def miss_taxonomy(spark, sf):
    h, d = hard(spark, sf), dense(spark, sf)
    v = fusion.votes(d, h, "sum").select("query_id", "pid", F.lit(1).alias("voted"))
    j = golds(spark, sf).join(h, "doc_id").join(vote_order(spark, sf).select("query_id", "pid", "rnk"), ["query_id", "pid"])
    j = j.join(d.select("query_id", "doc_id", F.lit(1).alias("got")), ["query_id", "doc_id"], "left").join(v, ["query_id", "pid"], "left")
    why = F.when(F.col("rnk") <= 3, "covered").when(F.col("got").isNull() & F.col("voted").isNull(), "not_voted").when(F.col("got").isNull(), "not_retrieved").otherwise("outranked")
    return j.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("golds"))


@query("gold_location", f"with {DENSE}, {GOLD}, al as (select query_id, doc_id, {RANK} as rnk from dense_s) select count(*)::BIGINT as golds, round(avg((rnk <= 20)::INT), 6) as in_20, round(avg((rnk <= 100)::INT), 6) as in_100, round(avg((rnk <= 500)::INT), 6) as in_500, quantile_cont(rnk, 0.5)::DOUBLE as median_rank from gold join al using (query_id, doc_id)")
def gold_location(spark, sf):
    every = rank_of(asked(spark, sf), items(spark, sf), golds(spark, sf))
    j = golds(spark, sf).join(every, ["query_id", "doc_id"])
    inside = lambda k: F.round(F.avg((F.col("rnk") <= k).cast("double")), 6).alias(f"in_{k}")
    return j.agg(F.count(F.lit(1)).alias("golds"), inside(20), inside(100), inside(500), F.percentile("rnk", F.lit(0.5)).alias("median_rank"))


@query("weakest_link", f"with {DENSE}, {GOLD}, w as (select g.query_id, max(coalesce(d.rnk, 101)) as w from gold g left join dense d using (query_id, doc_id) group by 1) select count(*)::BIGINT as queries, round(100 * avg((w > 100)::INT), 2) as censored, quantile_cont(w, 0.5)::DOUBLE as p50, quantile_cont(w, 0.75)::DOUBLE as p75, round(100 * avg((w <= 20)::INT), 2) as within_20 from w")
def weakest_link(spark, sf):
    m = metrics.per_query(dense(spark, sf), golds(spark, sf), [20], sentinel=K + 1)
    w = F.col("weakest")
    return m.agg(F.count(F.lit(1)).alias("queries"), F.round(100 * F.avg((w > K).cast("double")), 2).alias("censored"), F.percentile(w, F.lit(0.5)).alias("p50"), F.percentile(w, F.lit(0.75)).alias("p75"), F.round(100 * F.avg((w <= 20).cast("double")), 2).alias("within_20"))


@query("hard_negatives", f"with {DENSE}, {GOLD} select query_id, doc_id, rnk from dense where rnk <= 20 and not exists (select 1 from gold g where g.query_id = dense.query_id and g.doc_id = dense.doc_id)")
def hard_negatives(spark, sf):
    return dense(spark, sf, 20).join(golds(spark, sf), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "rnk")


@query("candidate_export", f"with {DENSE}, {GOLD} select d.query_id, string_agg(d.doc_id::VARCHAR, ',' order by d.rnk) as candidates, any_value(g.golds) as golds from dense d join (select query_id, string_agg(doc_id::VARCHAR, ',' order by doc_id) as golds from gold group by 1) g using (query_id) group by 1")
def candidate_export(spark, sf):
    """The candidate pool of each query, 100 ids in order, with its golds; lists are of fixed length."""
    ids = lambda c, *by: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: x[c].cast("string")))
    d = dense(spark, sf).groupBy("query_id").agg(ids("doc_id", "rnk").alias("candidates"))
    g = golds(spark, sf).groupBy("query_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))).alias("golds"))
    return d.join(g, "query_id")


@query("external_candidates", f"with {DENSE}, x as (select query_id, list(doc_id order by rnk) as ids from dense group by 1) select query_id, ids[i] as doc_id, i as rnk, (len(ids) - i + 1)::DOUBLE as score from x, range(1, 101) r(i) where i <= len(ids)")
def external_candidates(spark, sf):
    """Candidates given as plain id lists: the score is the length minus the 0-based rank."""
    x = dense(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "doc_id"))), lambda s: s["doc_id"]).alias("ids"))
    p = x.select("query_id", F.size("ids").alias("n"), F.posexplode("ids").alias("pos", "doc_id"))
    return p.select("query_id", "doc_id", (F.col("pos") + 1).cast("long").alias("rnk"), (F.col("n") - F.col("pos")).cast("double").alias("score"))


@query("paired_summary", f"""with {BOTH}, {GOLD}, o as (select g.query_id, max((coalesce(d.rnk, 999) <= 20)::INT) as a, max((coalesce(s.rnk, 999) <= 20)::INT) as b from gold g left join dense d using (query_id, doc_id) left join sgn s using (query_id, doc_id) group by 1)
    select count(*)::BIGINT as n, round(avg(a), 6) as treatment, round(avg(b), 6) as baseline, count(*) filter (where a > b)::BIGINT as wins, count(*) filter (where a < b)::BIGINT as losses from o""")
def paired_summary(spark, sf):
    g = golds(spark, sf)
    a = metrics.per_query(dense(spark, sf), g, [20]).select("query_id", F.col("hit_20").alias("a"))
    b = metrics.per_query(signs(spark, sf), g, [20]).select("query_id", F.col("hit_20").alias("b"))
    return a.join(b, "query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("treatment"), F.round(F.avg("b"), 6).alias("baseline"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))


@query("support_subgroups", f"with {DENSE}, {GOLD}, m as (select g.query_id, count(*) as n, avg((coalesce(d.rnk, 999) <= 20)::INT) as r from gold g left join dense d using (query_id, doc_id) group by 1) select n::BIGINT as golds, count(*)::BIGINT as queries, round(avg(r), 6) as recall_20 from m group by 1")
def support_subgroups(spark, sf):
    return metrics.per_query(dense(spark, sf), golds(spark, sf), [20]).groupBy("golds").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall_20"), 6).alias("recall_20"))


@query("maxsim", f"""with {U}, tk as (select doc_id, i as pos, v[(i * 16 + 1):(i * 16 + 16)] as t from u, range(0, 4) r(i)), s as (select a.doc_id as query_id, b.doc_id, a.pos, max(round(list_dot_product(a.t, b.t), 9)) as m from tk a, tk b where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id group by 1, 2, 3),
    t as (select query_id, doc_id, round(sum(m), 6) as score from s group by 1, 2) select * from (select query_id, {RANK} as rnk, doc_id, score from t) where rnk <= 20""")
def maxsim(spark, sf):
    """Late interaction over four 16-number parts of each vector: per part of the query the best
    part of the document, summed. Queries are held by the tasks, parts are compared as matrices."""
    import numpy as np
    import pyarrow as pa

    from evigraph.functions.vector import _matrix, _shape, query_blocks  # noqa: PLC2701

    (got,) = query_blocks(asked(spark, sf))  # one block at this size; of more, each is searched by itself
    held = spark.sparkContext.broadcast((got.column("query_id").to_numpy(), _shape(_matrix(got.column("vec")).astype(float), "unit")))

    def run(batches):
        ids, q = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column(0).to_numpy(), _shape(_matrix(batch.column(1)).astype(float), "unit")
            s = np.zeros((len(ids), len(own)))
            for i in range(4):
                s += np.max([np.round(q[:, 16 * i : 16 * i + 16] @ x[:, 16 * j : 16 * j + 16].T, 9) for j in range(4)], axis=0)
            s = np.round(s, 6)
            s[ids[:, None] == own[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :20]
            r, c = np.repeat(np.arange(len(s)), order.shape[1]), order.ravel()
            keep = np.isfinite(s[r, c])
            yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(own[c[keep]]), pa.array(s[r[keep], c[keep]])], names=["query_id", "doc_id", "score"])

    return ranked(items(spark, sf).select("doc_id", "vec").mapInArrow(run, "query_id long, doc_id long, score double"), 20)
