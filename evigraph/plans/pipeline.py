"""End-to-end pipelines: route, rerank, expand; and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evigraph.functions.vector import unit
from evigraph.operators import fusion, graph, partition
from evigraph.plans import retrieval as R
from evigraph.plans.registry import query
from evigraph.session import cut


@query("pipeline", f"""with {R.U}, {R.ROUTED}, {R.SCOPED}, {R.LINKS}, sd as (select query_id, doc_id, rnk from sc where rnk <= 10), nb as (select distinct sd.query_id, lm.dst as doc_id from sd join lm on lm.src = sd.doc_id where not exists (select 1 from sd x where x.query_id = sd.query_id and x.doc_id = lm.dst) and lm.dst <> sd.query_id),
    ns as (select nb.query_id, nb.doc_id, round(list_dot_product(a.v, b.v), 6) as score from nb join u a on a.doc_id = nb.query_id join u b on b.doc_id = nb.doc_id), nr as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rnk from ns),
    t as (select query_id, doc_id, min(struct_pack(t := t, r := rnk)) as p from (select query_id, doc_id, rnk, 0 as t from sd union all select query_id, doc_id, rnk, 1 from nr union all select query_id, doc_id, rnk, 2 from sc) where query_id <> doc_id group by 1, 2)
    select * from (select query_id, row_number() over (partition by query_id order by p.t, p.r, doc_id) as rnk, doc_id, p.t::BIGINT as tier from t) where rnk <= 20""")
def pipeline(spark, sf):
    """Route to three partitions, rank inside them, add the best hits' neighbours by similarity, fill
    up: the context of each query."""
    it = R.items(spark, sf).withColumn("vec", unit(F.col("vec")))
    q = R.asked(spark, sf).withColumn("vec", unit(F.col("vec")))
    ranked = cut(partition.scoped(q, R.routed(spark, sf, 3), it, 50))
    head = ranked.where("rnk <= 10")
    near = graph.reach(head.select("query_id", F.col("doc_id").alias("node")), R.id_links(spark, sf), 1).where("hop = 1 and node <> query_id")
    j = near.join(it.select(F.col("doc_id").alias("node"), F.col("vec").alias("b")), "node").join(q.select("query_id", F.col("vec").alias("a")), "query_id")
    from evigraph.functions.vector import dot
    from evigraph.functions.vector import ranked as order

    n = order(j.select("query_id", F.col("node").alias("doc_id"), F.round(dot(F.col("a"), F.col("b")), 6).alias("score")))
    return fusion.tiers([(df.where("query_id <> doc_id"), None) for df in (head, n, ranked)], 20)


@query("stream_event_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::BIGINT as n, round(sum(value), 4) as value from events group by 1, 2")
def stream_event_windows(spark, sf):
    from evigraph.streaming.events import run_windows

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        cut(spark.range(1))
    return run_windows(spark, f"{sf}/events*.parquet", f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}")
