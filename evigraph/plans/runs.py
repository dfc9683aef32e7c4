"""Contract, answer and statistics queries over ``run_rows``, ``queries`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.stats import mcnemar
from evigraph.operators import contract, metrics
from evigraph.plans.registry import query
from evigraph.sources.tables import once, table


def runs(spark, sf, *columns: str) -> DataFrame:
    t = table(spark, sf, "run_rows").select("id", *columns)
    return once(t, "id", *columns)


R = "r as (select distinct on (id) * from run_rows where id is not null)"
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
ANS = f"""pa as (select id, {NORM.format('prediction')} as p, {NORM.format('a')} as a, a is null as none from (select id, prediction, unnest(case when len(answers) > 0 then answers else [null] end) as a from r)),
    pt as (select *, list_filter(string_split(p, ' '), lambda x: x <> '') as pt, list_filter(string_split(a, ' '), lambda x: x <> '') as ta from pa),
    sm as (select *, coalesce(list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda y: y = w)), len(list_filter(ta, lambda y: y = w))))), 0) as same from pt),
    an as (select id, max(case when not none then (p = a and p <> '')::INT end) as em, round(max(case when not none then case when same > 0 then 2.0 * same / (len(pt) + len(ta)) else 0 end end), 6)::DOUBLE as f1 from sm group by id)"""


@query("answer_em_f1", f"with {R}, {ANS} select * from an")
def answer_em_f1(spark, sf):
    return metrics.answer_scores(runs(spark, sf, "prediction", "answers"), "id", "prediction", "answers")


@query("answer_by_system", f"with {R}, {ANS} select system, count(*)::BIGINT as n, count(em)::BIGINT as scored, round(100 * avg(em), 2) as em, round(100 * avg(f1), 2) as f1 from an join r using (id) group by system")
def answer_by_system(spark, sf):
    a = answer_em_f1(spark, sf).join(runs(spark, sf, "system"), "id")
    return a.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count("em").alias("scored"), F.round(100 * F.avg("em"), 2).alias("em"), F.round(100 * F.avg("f1"), 2).alias("f1"))


E2E = """b as (select id, system, list_distinct(coalesce(supporting_document_ids, [])) as g, list_distinct(retrieved_document_ids[1:{k}]) as t, retrieved_document_ids as rr from r), h as (select *, len(list_intersect(g, t)) as h from b)"""


@query("end_to_end", f"""with {R}, {ANS}, u as (select id, system, supporting_document_ids as s, retrieved_document_ids as rr, answers, contexts from r), x as (select id, system, list_distinct(coalesce(s, [])) as g, list_distinct(coalesce(rr[1:2], [])) as t2, list_distinct(coalesce(rr[1:5], [])) as t5, answers, contexts from u), y as (select *, len(list_intersect(g, t2)) as h2, len(list_intersect(g, t5)) as h5 from x),
    z as (select id, system, case when len(g) > 0 then round(h2 / len(g), 6) else 0 end as recall_2, (len(g) > 0 and h2 = len(g))::INT as full_2, case when h2 > 0 then round(2.0 * h2 / (len(g) + len(t2)), 6)::DOUBLE else 0 end as evidence_f1_2, case when len(g) > 0 then round(h5 / len(g), 6) else 0 end as recall_5, (len(g) > 0 and h5 = len(g))::INT as full_5, case when h5 > 0 then round(2.0 * h5 / (len(g) + len(t5)), 6)::DOUBLE else 0 end as evidence_f1_5,
    case when len(list_filter(answers, lambda a: trim(a) <> '')) > 0 then (len(list_filter(answers, lambda a: trim(a) <> '' and len(list_filter(contexts, lambda c: contains(lower(coalesce(c.text, '')), lower(a)))) > 0)) > 0)::INT end as answer_in_context from y)
    select z.*, em, f1, em * full_5 as joint_em, round(f1 * evidence_f1_5, 6) as joint_f1 from z join an using (id)""")
def end_to_end(spark, sf):
    r = runs(spark, sf, "system", "supporting_document_ids", "retrieved_document_ids", "prediction", "answers", "contexts")
    return contract.end_to_end(r, [2, 5])


@query("run_violations", "with r as (select * from run_rows) select distinct id, unnest(list_filter([case when id is null then 'missing id' end, case when coalesce(trim(question), '') = '' then 'missing question' end, case when len(retrieved_document_ids) <> len(list_distinct(retrieved_document_ids)) then 'repeated retrieved id' end, case when len(list_filter(contexts, lambda c: c.rank < 1)) > 0 or len(list_distinct(list_transform(contexts, lambda c: c.rank))) <> len(contexts) then 'bad context rank' end, case when latency_ms.total < 0 then 'negative latency' end, case when usage.prompt_tokens < 0 or usage.completion_tokens < 0 then 'negative usage' end], lambda x: x is not null)) as problem from r")
def run_violations(spark, sf):
    return contract.violations(table(spark, sf, "run_rows"))


@query("latency_summary", f"with {R} select system, count(latency_ms.total)::BIGINT as n, round(avg(latency_ms.total), 6) as mean, round(quantile_cont(latency_ms.total, 0.5), 6) as p50, round(quantile_cont(latency_ms.total, 0.95), 6) as p95, round(quantile_cont(latency_ms.total, 0.99), 6) as p99 from r where latency_ms.total is not null group by system")
def latency_summary(spark, sf):
    t = table(spark, sf, "run_rows").select("id", "system", F.col("latency_ms.total").alias("total"))
    return metrics.latency(once(t, "id", "system", "total"), ["system"], "total")


@query("usage_cost", f"with {R} select system, sum(usage.prompt_tokens)::BIGINT as prompt, sum(usage.completion_tokens)::BIGINT as completion, round(sum(usage.prompt_tokens) / 1e6 + 2 * sum(usage.completion_tokens) / 1e6, 6) as cost from r group by system")
def usage_cost(spark, sf):
    t = table(spark, sf, "run_rows").select("id", "system", F.col("usage.prompt_tokens").alias("p"), F.col("usage.completion_tokens").alias("c"))
    g = once(t, "id", "system", "p", "c").groupBy("system").agg(F.sum("p").alias("prompt"), F.sum("c").alias("completion"))
    return g.withColumn("cost", F.round(F.col("prompt") / 1e6 + 2 * F.col("completion") / 1e6, 6))


@query("hydrate", f"with {R}, p as (select id as query_id, unnest(retrieved_document_ids) as doc_id, generate_subscripts(retrieved_document_ids, 1) as pos from r), d as (select node_id as doc_id, any_value(metadata.title) as title from nodes group by 1), f as (select query_id, doc_id, min(pos) as pos from p group by 1, 2), k as (select query_id, doc_id, title, row_number() over (partition by query_id order by pos) as rnk from f join d using (doc_id)) select query_id, rnk, doc_id, title, rnk <= 2 as context from k where rnk <= 100")
def hydrate(spark, sf):
    ext = runs(spark, sf, "retrieved_document_ids").select(F.col("id").alias("query_id"), F.col("retrieved_document_ids").alias("doc_ids"))
    d = table(spark, sf, "nodes").select(F.col("node_id").alias("doc_id"), F.col("metadata.title").alias("title"))
    return contract.hydrate(ext, once(d, "doc_id", "title"), 2).select("query_id", "rnk", "doc_id", "title", "context")


PAIR = f"{R}, {ANS}, q as (select system, regexp_extract(id, '([0-9]+)$', 1) as pair, coalesce(em, 0) as em from an join r using (id))"


def _pairs(spark, sf) -> DataFrame:
    a = answer_em_f1(spark, sf).join(runs(spark, sf, "system", "question"), "id")
    return a.select("id", "system", "question", F.coalesce("em", F.lit(0)).alias("em"))


_TWO = "tw as (select system, row_number() over (order by count(*) desc, system) as place from r where system is not null group by system qualify place <= 2)"


@query("paired_compare", f"with {R}, {ANS}, {_TWO}, q as (select place, question as pair, max(coalesce(em, 0)) as v from an join r using (id) join tw using (system) where question is not null group by 1, 2), a as (select * from q where place = 1), b as (select * from q where place = 2) select count(*)::BIGINT as pairs, 0::BIGINT as unpaired, count(*) filter (where a.v > b.v)::BIGINT as wins, count(*) filter (where a.v = b.v)::BIGINT as ties, count(*) filter (where a.v < b.v)::BIGINT as losses, round(avg(a.v - b.v), 6) as difference from a join b on a.pair = b.pair")
def paired_compare(spark, sf):
    """The two systems with most rows (ties: by name), on the questions that both answered."""
    top = runs(spark, sf, "system").where("system is not null").groupBy("system").count().orderBy(F.desc("count"), "system").limit(2).collect()
    q = _pairs(spark, sf).where("question is not null").groupBy("system", F.col("question").alias("pair")).agg(F.max("em").alias("v"))
    first, second = (q.where(F.col("system") == r["system"]) for r in top)
    common = first.select("pair").intersect(second.select("pair"))
    return contract.compare(first.join(common, "pair", "left_semi"), second.join(common, "pair", "left_semi"), "v").drop("p")


@query("frozen_fields", f"with {R}, {_TWO}, x as (select system, question as pair, min(answers) as answers from r where question is not null group by 1, 2), a as (select x.* from x join tw using (system) where place = 1), b as (select x.* from x join tw using (system) where place = 2), j as (select a.pair as pa, b.pair as pb, a.answers as xa, b.answers as xb from a full join b on a.pair = b.pair) select case when pb is null then 'only in the first' when pa is null then 'only in the second' else 'answers differs' end as problem, count(*)::BIGINT as questions from j where pb is null or pa is null or xa is distinct from xb group by 1")
def frozen_fields(spark, sf):
    """Why the two largest systems' runs can't be paired as they are: questions of one only, and
    questions with other answers."""
    r = runs(spark, sf, "system", "question", "answers")
    top = r.where("system is not null").groupBy("system").count().orderBy(F.desc("count"), "system").limit(2).collect()
    x = r.where("question is not null").groupBy("system", F.col("question").alias("pair")).agg(F.min("answers").alias("answers"))
    first, second = (x.where(F.col("system") == s["system"]) for s in top)
    return contract.differing(first, second, "pair").groupBy("problem").agg(F.count(F.lit(1)).alias("questions"))


@query("mcnemar", f"""with {R}, {ANS}, o as (select system, (em = 1)::INT as x, (answers is not null and len(supporting_document_ids) = len(list_intersect(supporting_document_ids, coalesce(retrieved_document_ids, []))))::INT as y from an join r using (id) where em is not null), c as (select system, count(*) filter (where x > y)::BIGINT as b, count(*) filter (where x < y)::BIGINT as c from o group by system)
    select system, b, c, case when b + c = 0 then 1.0 else round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) end as p from c""")
def mcnemar_query(spark, sf):
    """Exact McNemar per system: answered right against fully covered by its evidence."""
    r = runs(spark, sf, "system", "supporting_document_ids", "retrieved_document_ids")
    a = answer_em_f1(spark, sf).where("em is not null").join(r, "id")
    full = F.size(F.array_intersect("supporting_document_ids", F.coalesce("retrieved_document_ids", F.array().cast("array<string>")))) == F.size("supporting_document_ids")
    o = a.select("system", F.col("em").alias("x"), full.cast("int").alias("y"))
    c = o.groupBy("system").agg(F.count_if(F.col("x") > F.col("y")).alias("b"), F.count_if(F.col("x") < F.col("y")).alias("c"))
    return c.withColumn("p", F.round(mcnemar(F.col("b"), F.col("c")), 6))


_DIGIT = "(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_HASHES = lambda seed, n: " || ".join(f"md5('{seed}:{i}:' || id)" for i in range(n))
_BYTE = f"(16 * {_DIGIT.format(at='2 * j + 1')} + {_DIGIT.format(at='2 * j + 2')})"


@query("bootstrap_ci", f"""with {R}, {ANS}, x as (select id, system, coalesce(em, 0)::DOUBLE as v, {_HASHES(7, 13)} as h from an join r using (id)), w as (select system, v, j, (select count(*) from (values (94), (188), (235), (251), (255)) t(t) where t.t <= {_BYTE}) as n from x, range(200) d(j)),
    m as (select system, j, sum(v * n) / sum(n) as m from w group by 1, 2) select system, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by 1""")
def bootstrap_ci(spark, sf):
    return contract.bootstrap(_pairs(spark, sf).select("id", "system", "em"), ["system"], "em")


@query("sign_flip_p", f"""with {R}, {ANS}, x as (select (em - f1)::DOUBLE as d, {_HASHES(11, 4)} as h from an where em is not null), o as (select abs(sum(d)) as o from x),
    f as (select j, abs(sum(d * (2 * (({_DIGIT.format(at='j // 4 + 1')} >> (3 - j % 4)) & 1) - 1))) as s from x, range(500) r(j) group by 1) select round((count(*) filter (where s >= o - 1e-9) + 1) / 501, 6) as p from f, o""")
def sign_flip_p(spark, sf):
    a = answer_em_f1(spark, sf).where("em is not null")
    return contract.sign_flip(a.select("id", (F.col("em") - F.col("f1")).alias("d")), "d")


@query("run_recall_curve", f"with {R}, g as (select distinct id, system, unnest(supporting_document_ids) as doc_id from r), p as (select id, doc_id, min(pos) as rnk from (select id, unnest(retrieved_document_ids) as doc_id, generate_subscripts(retrieved_document_ids, 1) as pos from r) group by 1, 2) select k::BIGINT as k, g.system, round(avg((coalesce(rnk, 999) <= k)::INT), 6) as gold_recall from g left join p using (id, doc_id), (values (1), (2), (5), (10)) b(k) group by 1, 2")
def run_recall_curve(spark, sf):
    r = runs(spark, sf, "system", "supporting_document_ids", "retrieved_document_ids")
    g = r.select("id", "system", F.explode(F.array_distinct("supporting_document_ids")).alias("doc_id"), "retrieved_document_ids")
    pos = F.coalesce(F.array_position("retrieved_document_ids", F.col("doc_id")), F.lit(0))
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 5, 10)])).alias("k")
    x = g.select("system", pos.alias("rnk"), ks)
    return x.groupBy("k", "system").agg(F.round(F.avg(((F.col("rnk") > 0) & (F.col("rnk") <= F.col("k"))).cast("double")), 6).alias("gold_recall"))


@query("corpus_stats", "with q as (select query_id, list_distinct(list_filter(golds, lambda x: x is not null and x <> -1)) as g from (select distinct on (query_id) * from queries)) select count(*)::BIGINT as questions, count(*) filter (where len(g) > 0)::BIGINT as with_gold, round(avg(len(g)) filter (where len(g) > 0), 6) as mean_golds, (select count(distinct x) from (select unnest(g) as x from q))::BIGINT as unique_golds from q")
def corpus_stats(spark, sf):
    t = table(spark, sf, "queries").select("query_id", F.array_distinct(F.filter("golds", lambda x: x.isNotNull() & (x != -1))).alias("g"))
    q = once(t, "query_id", "g")
    u = q.select(F.explode("g").alias("x")).agg(F.count_distinct("x").alias("unique_golds"))
    return q.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.size("g") > 0).alias("with_gold"), F.round(F.avg(F.when(F.size("g") > 0, F.size("g"))), 6).alias("mean_golds")).crossJoin(u)


@query("balanced_batches", "with q as (select distinct query_id, split_part(query_id, '_q_', 1) as dataset from queries), n as (select dataset, count(*) as n from q group by 1), m as (select ceil(max(n) / 64.0)::BIGINT as batches from n) select dataset, batches, n::BIGINT as eligible, (batches * 64)::BIGINT as drawn, floor(batches * 64.0 / n)::BIGINT as times, (batches * 64 - floor(batches * 64.0 / n) * n)::BIGINT as once_more from n, m")
def balanced_batches(spark, sf):
    """Equal numbers of batches a dataset: how often each question is drawn, and how many once more."""
    q = table(spark, sf, "queries").select("query_id").where("query_id is not null").distinct()
    n = q.groupBy(F.regexp_extract("query_id", "^(.*?)_q_", 1).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    m = n.agg(F.ceil(F.max("n") / 64).alias("batches"))
    d, t = F.col("batches") * 64, F.floor(F.col("batches") * 64 / F.col("n"))
    return n.crossJoin(F.broadcast(m)).select("dataset", "batches", F.col("n").alias("eligible"), d.alias("drawn"), t.alias("times"), (d - t * F.col("n")).alias("once_more"))


@query("event_sessions", "with e as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute as gap from events), s as (select *, sum(coalesce(gap, true)::INT) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e) select user_id, s::BIGINT as session, count(*)::BIGINT as events, round(sum(value), 6) as value from s group by 1, 2")
def event_sessions(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 1_800_000_000, F.lit(True))
    s = table(spark, sf, "events").withColumn("g", gap.cast("int")).withColumn("session", F.sum("g").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value"))


@query("moving_relevance", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 14 preceding and current row), 6) as mean15 from events")
def moving_relevance(spark, sf):
    """Mean of the last 15 values of a user, as a traversal's moving relevance."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-14, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean15"))


@query("metric_pivot", f"with {R}, {ANS}, {_TWO}, m as (select place, avg(em) as em, avg(f1) as f1 from an join r using (id) join tw using (system) group by 1) select metric, round(max(value) filter (where place = 1), 6) as first, round(max(value) filter (where place = 2), 6) as second from (select place, 'em' as metric, em as value from m union all select place, 'f1', f1 from m) group by metric")
def metric_pivot(spark, sf):
    """Metrics of the two systems with most rows side by side."""
    top = runs(spark, sf, "system").where("system is not null").groupBy("system").count().orderBy(F.desc("count"), "system").limit(2).collect()
    names = {r["system"]: c for r, c in zip(top, ("first", "second"))}
    m = _pairs_all(spark, sf).groupBy("metric").pivot("system", list(names)).agg(F.round(F.max("value"), 6))
    return m.select("metric", *[F.col(f"`{s}`").alias(c) for s, c in names.items()])


def _pairs_all(spark, sf) -> DataFrame:
    a = answer_em_f1(spark, sf).join(runs(spark, sf, "system"), "id").groupBy("system").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    return a.unpivot("system", ["em", "f1"], "metric", "value")


@query("kg_hierarchy", "select r_name, count(distinct n_nationkey)::BIGINT as nations, count(distinct c_custkey)::BIGINT as customers, count(o_orderkey)::BIGINT as orders, round(sum(o_totalprice), 2) as total from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1")
def kg_hierarchy(spark, sf):
    """A typed hierarchy walked down by its foreign keys; orders are folded per customer first."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name").agg(F.count_distinct("c_nationkey").alias("nations"), F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"), F.sum("t").cast("double").alias("total"))
