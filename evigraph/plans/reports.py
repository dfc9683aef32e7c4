"""Reports and features on top of the other plans: losses, budgets by documents, schedules, linkage of
golds, warnings on incomplete tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import ranked
from evigraph.operators import graph, lexical, metrics, partition
from evigraph.plans import nodes as N
from evigraph.plans import retrieval as V
from evigraph.plans import text as X
from evigraph.plans.registry import query
from evigraph.plans.runs import ANS, R, answer_em_f1, runs
from evigraph.sources.tables import table

# --- losses -----------------------------------------------------------------------------------------
_L = f"{V.BOTH}, {V.GOLD}, l as (select d.query_id, d.doc_id, d.score / 0.05 as x, (g.doc_id is not null)::INT as pos, coalesce(s.score, 0) / 16.0 as t from dense d left join gold g using (query_id, doc_id) left join sgn s using (query_id, doc_id)), k as (select distinct query_id from l where pos = 1), lp as (select l.*, x - (max(x) over w + ln(sum(exp(x - mx)) over w)) as lq, t - (max(t) over w + ln(sum(exp(t - mt)) over w)) as lt from (select *, max(x) over (partition by query_id) as mx, max(t) over (partition by query_id) as mt from l join k using (query_id)) l window w as (partition by query_id))"


@query("loss_table", f"with {_L}, mg as (select query_id, avg(greatest(0, 1.0 - min_p + x)) as margin from (select *, min(case when pos = 1 then x end) over (partition by query_id) as min_p from lp) where pos = 0 group by 1), b as (select query_id, sum(exp(lt) * (lt - lq)) as kl, -avg(case when pos = 1 then lq end) as listwise, max(case when pos = 1 then -lq end) as worst, avg(case when pos = 1 then ln(1 + exp(-least(50, x))) else ln(1 + exp(least(50, x))) end) as pointwise from lp group by 1) select query_id, round(kl, 6) as kl, round(listwise, 6) as listwise, round(worst, 6) as worst, round(pointwise, 6) as pointwise, round(margin, 6) as margin from b join mg using (query_id)")
def loss_table(spark, sf):
    """Forward values, over the hundred best at temperature 0.05: divergence from the second list's
    softmax, mean and worst log loss of the golds, logistic loss of each candidate, mean hinge of the
    others against the weakest gold."""
    g = V.golds(spark, sf).withColumn("pos", F.lit(1))
    s = V.signs(spark, sf).select("query_id", "doc_id", (F.col("score") / 16.0).alias("t"))
    own = V.dense(spark, sf).join(g, ["query_id", "doc_id"], "left").join(s, ["query_id", "doc_id"], "left")
    own = own.select("query_id", (F.col("score") / 0.05).alias("x"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("t", F.lit(0.0)).alias("t"))
    w = W.partitionBy("query_id")  # a hundred rows
    own = own.withColumns({"any": F.max("pos").over(w), "mx": F.max("x").over(w), "mt": F.max("t").over(w), "low": F.min(F.when(F.col("pos") == 1, F.col("x"))).over(w)}).where("any = 1")
    own = own.withColumns({
        "lq": F.col("x") - F.col("mx") - F.log(F.sum(F.exp(F.col("x") - F.col("mx"))).over(w)), "lt": F.col("t") - F.col("mt") - F.log(F.sum(F.exp(F.col("t") - F.col("mt"))).over(w)),
    })
    pos, x = F.col("pos") == 1, F.col("x")
    out = own.groupBy("query_id").agg(
        F.sum(F.exp("lt") * (F.col("lt") - F.col("lq"))).alias("kl"), (-F.avg(F.when(pos, F.col("lq")))).alias("listwise"), F.max(F.when(pos, -F.col("lq"))).alias("worst"),
        F.avg(F.log(1 + F.exp(F.when(pos, -F.least(F.lit(50.0), x)).otherwise(F.least(F.lit(50.0), x))))).alias("pointwise"),
        F.avg(F.when(~pos, F.greatest(F.lit(0.0), 1.0 - F.col("low") + x))).alias("margin"),
    ).where("margin is not null")
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("kl", "listwise", "worst", "pointwise", "margin")])


# --- rankings inside a scope --------------------------------------------------------------------------
@query("scoped_sparse", f"with {X.POST}, {X.STAT}, {X.IDF}, {X.SPARSE}, s as (select a.doc_id as query_id, b.doc_id, round(sum(a.w * b.w), 6) as score from sv a join sv b using (term) join documents x on x.doc_id = a.doc_id join documents y on y.doc_id = b.doc_id where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id and x.source = y.source group by 1, 2) select * from (select query_id, {X.RANK} as rnk, doc_id, score from s where score > 0) where rnk <= 10")
def scoped_sparse(spark, sf):
    """Sparse vectors compared inside a query's own source, which is part of the join."""
    v = lexical.sparse_vectors(X.docs(spark, sf))
    s = table(spark, sf, "documents").where("source is not null").select("doc_id", "source")
    d = v.join(s, "doc_id")
    q = d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "term", "source", F.col("w").alias("qw"))
    hits = q.join(d, ["term", "source"]).where("query_id <> doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    return ranked(hits.where("score > 0"), 10)


# --- coverage by the share of documents opened --------------------------------------------------------
@query("docfrac_coverage", f"with {V.DENSE}, {V.ROUTE}, {V.GOLD}, z as (select pid, count(*) as n from e group by pid), c as (select rt.query_id, rt.pid, sum(n) over (partition by rt.query_id order by rt.rnk) / (select count(*) from e) as frac from rt join z using (pid)), w as (select g.query_id, max(c.frac) as need from gold g join e using (doc_id) join c on c.query_id = g.query_id and c.pid = e.pid group by 1) select f.f::DOUBLE as fraction, round(avg((w.need <= f.f)::INT), 6) as full_coverage, round(avg(w.need), 6) as mean_need from w, (values (0.1), (0.25), (0.5), (1.0)) f(f) group by 1")
def docfrac_coverage(spark, sf):
    """How often all golds lie in the routed partitions that a share of the documents pays for."""
    h = V.hard(spark, sf)
    z = h.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    total = h.count()
    c = V.vote_order(spark, sf).join(z, "pid").withColumn("frac", F.sum("n").over(W.partitionBy("query_id").orderBy("rnk")) / total).select("query_id", "pid", "frac")
    need = V.golds(spark, sf).join(h, "doc_id").join(c, ["query_id", "pid"]).groupBy("query_id").agg(F.max("frac").alias("need"))
    at = need.select("need", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 1.0)])).alias("fraction"))
    return at.groupBy("fraction").agg(F.round(F.avg((F.col("need") <= F.col("fraction")).cast("double")), 6).alias("full_coverage"), F.round(F.avg("need"), 6).alias("mean_need"))


# --- schedules ------------------------------------------------------------------------------------------
_SCHED = "q as (select distinct query_id, split_part(query_id, '_q_', 1) as dataset from queries where query_id is not null), n as (select dataset, count(*) as n from q group by 1), o as (select query_id, dataset, row_number() over (partition by dataset order by md5(query_id), query_id) - 1 as i from q)"


@query("epoch_schedule", f"with {_SCHED}, m as (select ceil(max(n) / 64.0)::BIGINT * 64 as slots from n) select dataset, query_id, i // 64 as batch, ((slots - 1 - i) // n + 1)::BIGINT as times from o join n using (dataset), m where i < slots")
def epoch_schedule(spark, sf):
    """Each question's first batch and how often it is drawn in an epoch in which every dataset fills
    equally many batches of 64, by the order of a hash."""
    q = table(spark, sf, "queries").where("query_id is not null").select("query_id", F.regexp_extract("query_id", "^(.*?)_q_", 1).alias("dataset")).distinct()
    n = q.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    slots = int(-(-(n.agg(F.max("n")).first()[0] or 0) // 64) * 64)
    o = partition.in_groups(q.withColumn("h", F.conv(F.substring(F.md5("query_id"), 1, 15), 16, 10).cast("long")), "dataset", "h")
    o = o.join(partition.small(n), "dataset").where(F.col("idx") < slots)
    return o.select("dataset", "query_id", F.floor(F.col("idx") / 64).alias("batch"), (F.floor((F.lit(slots - 1) - F.col("idx")) / F.col("n")) + 1).alias("times"))


# --- features and edges ----------------------------------------------------------------------------------
@query("degree_features", f"with {N.BASE}, dg as (select src as node, count(*) as degree from ed group by 1), sc as (select node_id as node, source from n) select node, degree::BIGINT as degree, round(degree / max(degree) over (), 6) as relative, coalesce(source, '') as part, count(*) over (partition by coalesce(source, ''))::BIGINT as part_size from dg join sc using (node)")
def degree_features(spark, sf):
    """Degree, also relative to the largest, and the partition of each node, as its source."""
    d = graph.degrees(N.edges(spark, sf))
    most = d.agg(F.max("degree")).first()[0] or 1
    s = N.nodes(spark, sf, "source").select(F.col("node_id").alias("node"), F.coalesce("source", F.lit("")).alias("part"))
    own = d.join(s, "node")
    size = own.groupBy("part").agg(F.count(F.lit(1)).alias("part_size"))
    return own.join(size, "part").select("node", "degree", F.round(F.col("degree") / most, 6).alias("relative"), "part", "part_size")


@query("entity_graph_capped", f"with {X.POST}, en as (select term, doc_id, row_number() over (partition by term order by doc_id) as r from po where regexp_matches(term, '^[a-z]{{6,}}$')), c as (select term, doc_id from en where r <= 20) select a.doc_id as src, b.doc_id as dst, count(*)::BIGINT as shared from c a join c b using (term) where a.doc_id <> b.doc_id group by 1, 2 having count(*) >= 3")
def entity_graph_capped(spark, sf):
    """Documents that share three words or more, of each word the first twenty documents: the cap is
    the operator's."""
    p = lexical.postings(X.docs(spark, sf)).where(F.col("term").rlike("^[a-z]{6,}$")).select("doc_id", "term")
    c = p.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy("doc_id"))).where("r <= 20").drop("r")
    a, b = c.select("term", F.col("doc_id").alias("src")), c.select("term", F.col("doc_id").alias("dst"))
    return a.join(b, "term").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 3")


# --- systems ------------------------------------------------------------------------------------------
@query("system_report", f"with {R}, {ANS}, g as (select id, system, list_distinct(supporting_document_ids) as g, retrieved_document_ids as rt from r where system is not null), x as (select id, system, (select min(list_position(rt, d)) from (select unnest(g) as d) where list_position(rt, d) > 0) as first from g) select x.system, count(*)::BIGINT as rows, round(avg(coalesce(em, 0)), 6) as accuracy, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from x left join an using (id) group by 1")
def system_report(spark, sf):
    """Rows, accuracy of the answers and reciprocal rank of the first gold, by system."""
    r = runs(spark, sf, "system", "supporting_document_ids", "retrieved_document_ids").where("system is not null")
    pos = F.array_min(F.filter(F.transform(F.array_distinct("supporting_document_ids"), lambda d: F.array_position("retrieved_document_ids", d)), lambda i: i > 0))
    x = r.select("id", "system", F.coalesce(1.0 / pos, F.lit(0.0)).alias("rr")).join(answer_em_f1(spark, sf), "id", "left")
    return x.groupBy("system").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.coalesce("em", F.lit(0)).cast("double")), 6).alias("accuracy"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("leaderboard_gaps", f"with {R}, c as (select system, split_part(question, ' ', 1) as kind, count(*) as n from r where system is not null and question is not null group by 1, 2), k as (select kind from c group by 1 order by sum(n) desc, kind limit 5), s as (select distinct system from c) select s.system, k.kind, coalesce(c.n, 0)::BIGINT as n, coalesce(c.n, 0) < 5 as too_few from s cross join k left join c on c.system = s.system and c.kind = k.kind")
def leaderboard_gaps(spark, sf):
    """Cells of a table of systems by the five most frequent kinds of question, with a warning where a
    cell is missing or holds fewer than five rows."""
    r = runs(spark, sf, "system", "question").where("system is not null and question is not null")
    c = r.groupBy("system", F.substring_index("question", " ", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = [x["kind"] for x in c.groupBy("kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind").limit(5).collect()]
    cells = c.select("system").distinct().select("system", F.explode(F.lit(kinds).cast("array<string>")).alias("kind"))
    n = F.coalesce("n", F.lit(0))
    return cells.join(c, ["system", "kind"], "left").select("system", "kind", n.alias("n"), (n < 5).alias("too_few"))


@query("gold_linkage", f"with {N.BASE}, p as (select a.query_id, a.doc_id as x, b.doc_id as y from go a join go b on a.query_id = b.query_id and a.doc_id < b.doc_id), c as (select * from n where coalesce(type, '') <> 'question') select (select count(*) from p)::BIGINT as pairs, (select count(*) from p join ed on ed.src = p.x and ed.dst = p.y)::BIGINT as linked, round((select avg((node_id not in (select src from ed))::INT) from c), 6) as orphans, round((select count(*) from ed) / ((select count(*) from c) * ((select count(*) from c) - 1.0)), 9) as chance")
def gold_linkage(spark, sf):
    """Pairs of golds of one question and how many are linked, against the chance that two documents
    are, and the share of documents without a link."""
    from evigraph.operators.substrate import question_golds

    n = N.nodes(spark, sf, "type", "neighbors")
    g, e = question_golds(n), N.edges(spark, sf)
    # a question's golds are few
    p = g.toDF("query_id", "x").join(g.toDF("query_id", "y"), "query_id").where("x < y")
    linked = p.join(e.toDF("x", "y"), ["x", "y"], "left_semi").count()
    docs = n.where(F.coalesce("type", F.lit("")) != "question").select(F.col("node_id").alias("src"))
    size, edges = docs.count(), e.count()
    alone = docs.join(e.select("src").distinct(), "src", "left_anti").count()
    return p.agg(F.count(F.lit(1)).alias("pairs")).select(
        "pairs", F.lit(linked).cast("long").alias("linked"), F.round(F.lit(alone / max(1, size)), 6).alias("orphans"), F.round(F.lit(edges / max(1.0, size * (size - 1.0))), 9).alias("chance"),
    )


@query("metrics_k_grid", f"with {V.DENSE}, {V.GOLD}, j as (select g.query_id, d.rnk from gold g left join dense d using (query_id, doc_id)) select k.k::BIGINT as k, round(avg(r), 6) as recall, round(avg(f), 6) as full_coverage, round(avg(h), 6) as hit from (select k, query_id, avg((coalesce(rnk, 9999) <= k)::INT) as r, min((coalesce(rnk, 9999) <= k)::INT) as f, max((coalesce(rnk, 9999) <= k)::INT) as h from j, (values (1), (2), (5), (10), (20), (50), (100)) k(k) group by 1, 2) k group by 1")
def metrics_k_grid(spark, sf):
    """Recall, full coverage and hit rate at a grid of cutoffs, in one pass."""
    j = metrics.gold_ranks(V.dense(spark, sf), V.golds(spark, sf)).select("query_id", F.coalesce("rnk", F.lit(9999)).alias("rnk"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 5, 10, 20, 50, 100)])).alias("k"))
    i = (F.col("rnk") <= F.col("k")).cast("int")
    q = j.groupBy("k", "query_id").agg(F.avg(i).alias("r"), F.min(i).alias("f"), F.max(i).alias("h"))
    return q.groupBy("k").agg(F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("full_coverage"), F.round(F.avg("h"), 6).alias("hit"))
