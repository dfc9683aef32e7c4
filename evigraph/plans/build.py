"""Building a corpus: deduplication with remapped golds, recovery of titles, official splits, entity
nodes, and the whole rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.operators import fusion, graph, partition
from evigraph.plans import retrieval as V
from evigraph.plans.registry import query
from evigraph.sources.tables import once, table

_FIRST = "dd as (select doc_id, min(doc_id) over (partition by coalesce(title, ''), title is null, md5(coalesce(text, '')), text is null) as first from documents where doc_id is not null), fi as (select first, row_number() over (order by first) - 1 as new_id from (select distinct first from dd))"
_Q = "q as (select distinct query_id, golds from queries where query_id is not null), gs as (select distinct query_id, fi.new_id from (select query_id, unnest(golds) as g from q) x join dd on dd.doc_id = x.g join fi using (first))"


def first_of(spark, sf) -> DataFrame:
    """``(doc_id, first, new_id)``: each document with the smallest id of those with its title and text,
    and the dense number of that one."""
    d = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.struct("title", F.md5("text").alias("h")).alias("k"))
    first = d.groupBy(F.col("k").alias("kk")).agg(F.min("doc_id").alias("first"))
    new = partition.dense_rank_of(first.select("first"), "first").select("first", F.col("idx").cast("long").alias("new_id"))
    return d.join(first, F.col("k").eqNullSafe(F.col("kk"))).select("doc_id", "first").join(new, "first")


@query("dedup_golds", f"with {_FIRST}, {_Q} select query_id, list_sort(list(new_id))::VARCHAR as golds, count(*)::BIGINT as n from gs group by 1")
def dedup_golds(spark, sf):
    """Questions over the deduplicated corpus: golds point at the first of their copies by its new
    dense id, questions that are left without a gold go."""
    q = once(table(spark, sf, "queries").select("query_id", "golds"), "query_id", "golds")
    g = q.select("query_id", F.explode("golds").alias("doc_id")).join(first_of(spark, sf), "doc_id").select("query_id", "new_id").distinct()
    # a question's golds are few
    return g.groupBy("query_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("new_id")), lambda x: x.cast("string")), ", "), F.lit("]")).alias("golds"), F.count(F.lit(1)).alias("n"))


@query("title_recovery", "with t as (select md5(text) as h, min(title) as title from documents where text is not null and trim(title) <> '' group by 1) select d.doc_id, t.title from documents d join t on t.h = md5(d.text) where d.title is null and d.text is not null")
def title_recovery(spark, sf):
    """Missing titles, had from a document of the same content."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "title", F.md5("text").alias("h"))
    known = d.where("trim(title) <> ''").groupBy("h").agg(F.min("title").alias("known"))
    return d.where("title is null").join(known, "h").select("doc_id", F.col("known").alias("title"))


_OFFICIAL = "case when regexp_matches(lower(split), '\\btrain(ing)?\\b') then 'train' when regexp_matches(lower(split), '\\btest\\b') then 'test' when regexp_matches(lower(split), '\\b(val|valid|validation|dev|development)\\b') then 'val' end"


def official(c):
    """``train``, ``val`` or ``test`` of a split's own wording, else null."""
    s = F.lower(c)
    return F.when(s.rlike(r"\btrain(ing)?\b"), "train").when(s.rlike(r"\btest\b"), "test").when(s.rlike(r"\b(val|valid|validation|dev|development)\b"), "val")


@query("split_official", f"with q as (select distinct query_id, view_id from queries where query_id is not null), o as (select query_id, {_OFFICIAL} as split from q left join views using (view_id)), h as (select query_id, row_number() over (order by md5(query_id), query_id) - 1 as i, count(*) over () as n from o where split is null) select query_id, coalesce(split, case when i < floor(0.7 * n) then 'train' when i < floor(0.7 * n) + floor(0.2 * n) then 'val' else 'test' end) as split from o left join h using (query_id)")
def split_official(spark, sf):
    """Official splits where a question's view has one; the others 70/20/10 by the order of a hash."""
    q = once(table(spark, sf, "queries").select("query_id", "view_id"), "query_id", "view_id")
    v = table(spark, sf, "views").select("view_id", official(F.col("split")).alias("split"))
    o = q.join(partition.small(v), "view_id", "left").select("query_id", "split")
    return o.where("split is not null").unionByName(partition.hash_split(o.where("split is null").select("query_id"), "query_id"))


_ENT = "en as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) as entity from documents where text is not null and doc_id is not null), ef as (select entity from en group by 1 having count(*) between 2 and 25)"


@query("entity_nodes", f"with {_ENT} select entity, count(*)::BIGINT as docs, min(doc_id) as first from en join ef using (entity) group by 1")
def entity_nodes(spark, sf):
    """Entities as nodes: capitalised words that 2 to 25 documents name, by a pattern in place of a
    tagger."""
    return entities(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"))


def entities(spark, sf) -> DataFrame:
    """``(doc_id, entity)`` of the entities that are nodes."""
    d = table(spark, sf, "documents").where("text is not null and doc_id is not null")
    e = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("entity"))
    few = e.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 25")
    return e.join(few.select("entity"), "entity")


@query("entity_links", f"with {_ENT} select distinct a.doc_id as src, b.doc_id as dst from en a join ef using (entity) join en b using (entity) where a.doc_id <> b.doc_id")
def entity_links(spark, sf):
    """Documents tied through an entity node, both ways; the bound on an entity's documents bounds the
    pairs."""
    e = entities(spark, sf)
    a, b = e.select("entity", F.col("doc_id").alias("src")), e.select("entity", F.col("doc_id").alias("dst"))
    return a.join(b, "entity").where("src <> dst").select("src", "dst").distinct()


@query("zscore_weighted", f"with {V.BOTH}, z as (select list, query_id, doc_id, (case when stddev_pop(score) over w > 0 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end) * stddev_pop(score) over w / (abs(avg(score) over w) + 1e-9) as score from ({V.HALL}) window w as (partition by list, query_id)) select query_id, {V.RANK} as rnk, doc_id, score from (select query_id, doc_id, round(sum(score), 6) as score from z group by 1, 2)")
def zscore_weighted(spark, sf):
    """z-scores weighted by how far a list spreads its scores, the spread over the mean."""
    out = None
    w = W.partitionBy("query_id")
    for own in V.lists(spark, sf).values():
        m, s = F.avg("score").over(w), F.stddev_pop("score").over(w)
        z = own.select("query_id", "doc_id", (F.when(s > 0, (F.col("score") - m) / s).otherwise(0.0) * s / (F.abs(m) + 1e-9)).alias("z"))
        out = z if out is None else out.unionByName(z)
    from evigraph.functions.vector import ranked

    return ranked(out.groupBy("query_id", "doc_id").agg(F.round(F.sum("z"), 6).alias("score")))


@query("onehop_cosine", f"with {V.DENSE}, {V.LINKS}, s as (select distinct d.query_id, lm.dst as doc_id from dense d join lm on lm.src = d.doc_id where d.rnk <= 5 and lm.dst <> d.query_id) select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rnk, doc_id, score from s join dense_s using (query_id, doc_id)")
def onehop_cosine(spark, sf):
    """Neighbours of the five best, by their cosine."""
    from evigraph.functions.vector import ranked

    near = V.dense(spark, sf, 5).join(V.id_links(spark, sf).withColumnRenamed("src", "doc_id"), "doc_id").select("query_id", F.col("dst").alias("doc_id")).where("doc_id <> query_id").distinct()
    return ranked(V.scored(spark, sf, near))


@query("rebuild", f"with {V.E}, {V.LINKS}, {_FIRST} select (select count(*) from fi)::BIGINT as documents, (select count(*) from documents)::BIGINT - (select count(*) from fi)::BIGINT as copies, (select count(*) from lm)::BIGINT as edges, (select count(distinct pid) from (select (row_number() over (order by doc_id) - 1) // 100 as pid from e))::BIGINT as partitions")
def rebuild(spark, sf):
    """The steps of a rebuild from raw tables, in numbers: deduplicated documents, undirected edges,
    partitions of 100."""
    d = first_of(spark, sf).agg(F.count_distinct("first").alias("documents"), (F.count(F.lit(1)) - F.count_distinct("first")).alias("copies"))
    e = V.id_links(spark, sf).agg(F.count(F.lit(1)).alias("edges"))
    p = partition.chunks(V.hard(spark, sf).select("doc_id"), "doc_id", 100).agg(F.count_distinct("pid").alias("partitions"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  single rows
    return one(d).join(one(e), "_one").join(one(p), "_one").drop("_one")
