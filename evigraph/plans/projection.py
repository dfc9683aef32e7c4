"""Rows of mixed shapes, rank projections, prompts, JSON and map functions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import fusion
from evigraph.plans.registry import query
from evigraph.plans.runs import R, runs
from evigraph.sources.tables import table

# --- rows of mixed shapes ---------------------------------------------------------------------------
@query("retrieved_ids", f"with {R}, e as (select id, unnest(retrieved_document_ids) as doc_id, generate_subscripts(retrieved_document_ids, 1) as i from r), d as (select id, doc_id, min(i) as i from e where doc_id is not null group by 1, 2) select id, doc_id, row_number() over (partition by id order by i) - 1 as pos from d")
def retrieved_ids(spark, sf):
    """Retrieved ids out of rows written in five shapes: a list under one of several names, objects
    under ``id``, ``document_id`` or ``title``, an object that holds the list."""
    r = runs(spark, sf, "retrieved_document_ids").where("retrieved_document_ids is not null")
    ids = F.col("retrieved_document_ids")
    as_objects = lambda name: F.transform(ids, lambda x: F.struct(x.alias(name)))
    shapes = [
        F.to_json(F.struct(ids.alias("retrieved_document_ids"))), F.to_json(F.struct(ids.alias("doc_ids"))), F.to_json(F.struct(as_objects("document_id").alias("document_ids"))),
        F.to_json(F.struct(F.struct(as_objects("id").alias("document")).alias("retrieved_docs"))), F.to_json(F.struct(F.struct(as_objects("title").alias("passages")).alias("retrieved_docs"))),
    ]
    rows = r.select("id", F.array(*shapes)[F.pmod(F.crc32("id"), F.lit(len(shapes))).cast("int")].alias("row"))
    return rows.select("id", F.posexplode(T.retrieved_ids(F.col("row"))).alias("pos", "doc_id"))


@query("metadata_answers", f"with {R}, e as (select id, unnest(answers) as answer from r) select id, answer from (select distinct id, answer from e where answer <> '')")
def metadata_answers(spark, sf):
    """Known answers out of metadata that holds them as a text, a list, an object or a list of objects
    under several names; each once, sorted."""
    r = runs(spark, sf, "answers").where("size(answers) > 0")
    a = F.col("answers")
    shapes = [
        F.to_json(F.struct(a.alias("answers"))), F.to_json(F.struct(F.transform(a, lambda x: F.struct(x.alias("text"))).alias("gold_answers"))),
        F.to_json(F.struct(a[0].alias("answer"), F.transform(a, lambda x: F.struct(x.alias("answer"))).alias("answers"))), F.to_json(F.struct(F.struct(a[0].alias("text")).alias("gold_answer"), a.alias("answers"))),
    ]
    rows = r.select("id", F.array(*shapes)[F.pmod(F.crc32("id"), F.lit(len(shapes))).cast("int")].alias("meta"))
    return rows.select("id", F.explode(T.metadata_answers(F.col("meta"))).alias("answer"))


@query("csv_sections", "select doc_id, 1::BIGINT as pos, replace(text, chr(13), '') as content from documents where replace(text, chr(13), '') <> '' and not contains(text, '```')")
def csv_sections(spark, sf):
    """The content column of the CSV section of a context blob, quoted fields over several lines
    among it."""
    d = table(spark, sf, "documents").where("doc_id is not null").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    d = d.where((F.col("text") != "") & ~F.col("text").contains("```"))
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    blob = F.concat(F.lit('-----Sources-----\n```csv\n"id","content"\n'), F.col("doc_id").cast("string"), F.lit(","), quoted, F.lit("\n```\n"))
    return T.csv_section(d.select("doc_id", blob.alias("blob")), "doc_id", "blob", "content")


@query("prompts", f"""with {R}, c as (select id, question, unnest(contexts) as c, generate_subscripts(contexts, 1) as i from r where len(contexts) > 0), t as (select id, any_value(question) as question, string_agg(regexp_replace('[' || i || '] ' || coalesce(c.title, '') || chr(10) || coalesce(c.text, ''), '\\s+$', ''), chr(10) || chr(10) order by i) as x from c group by id)
    select id, md5('Answer the question using only the context below. If the answer is not supported, say that it is not available.' || chr(10) || chr(10) || 'Context:' || chr(10) || x || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') as prompt from t where question is not null""")
def prompts(spark, sf):
    """The reader's prompt of each row with contexts, as a hash."""
    r = runs(spark, sf, "question", "contexts").where("size(contexts) > 0 and question is not null")
    return r.select("id", F.md5(T.prompt(F.col("question"), F.col("contexts"))).alias("prompt"))


# --- projections -----------------------------------------------------------------------------------
_CHUNK = "ch as (select node_id, any_value(metadata.title) as title from nodes where metadata.type is distinct from 'question' group by 1)"


@query("chunk_to_document", f"with {R}, {_CHUNK}, e as (select id, unnest(retrieved_document_ids) as chunk, generate_subscripts(retrieved_document_ids, 1) as i from r), d as (select id, title as doc, min(i) as i from e join ch on ch.node_id = chunk where title is not null group by 1, 2) select id, doc, row_number() over (partition by id order by i) as rnk from d qualify rnk <= 5")
def chunk_to_document(spark, sf):
    """Retrieved passages as a ranking of their documents, told by their titles."""
    n = table(spark, sf, "nodes").where("metadata.type is null or metadata.type <> 'question'").groupBy("node_id").agg(F.first("metadata.title").alias("doc"))
    c = runs(spark, sf, "retrieved_document_ids").select("id", F.posexplode("retrieved_document_ids").alias("pos", "chunk"))
    return fusion.project(c.withColumnRenamed("id", "query_id"), n.where("doc is not null").withColumnRenamed("node_id", "chunk"), 5).withColumnRenamed("query_id", "id")


_TREE = "tn as (select query_id, doc_id // 4 as node, min(rnk) as r from dense group by 1, 2), ts as (select query_id, node, row_number() over (partition by query_id order by r, node) as rnk from tn qualify rnk <= 20)"


def _tree_sql() -> str:
    from evigraph.plans import retrieval as V

    return f"with {V.DENSE}, {_TREE}, f as (select query_id, doc_id, round(sum(1.0 / (60 + rnk)), 9) as score from (select ts.query_id, e.doc_id, ts.rnk from ts join e on e.doc_id // 4 = ts.node union all select query_id, doc_id, rnk from dense) group by 1, 2) select * from (select query_id, {V.RANK} as rnk, doc_id, score from f) where rnk <= 30"


@query("tree_dense_rrf", _tree_sql())
def tree_dense_rrf(spark, sf):
    """Selected tree nodes, which stand for all documents under them, and a dense ranking, as one
    ranking of documents. Nodes hold four documents each."""
    from pyspark.sql import Window as W

    from evigraph.plans import retrieval as V

    d = V.dense(spark, sf).select("query_id", "doc_id", "rnk")
    n = d.groupBy("query_id", F.floor(F.col("doc_id") / 4).alias("node")).agg(F.min("rnk").alias("r"))
    n = n.withColumn("rnk", F.row_number().over(W.partitionBy("query_id").orderBy("r", "node"))).where("rnk <= 20").drop("r")
    under = V.hard(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 4).alias("node"))
    return fusion.tree_and_dense(n, under, d, 30)


# --- JSON, maps and sets ---------------------------------------------------------------------------
@query("json_fields", "with j as (select distinct node_id, content from nodes where content like '{%' and json_valid(content)), k as (select node_id, content, unnest(json_keys(content)) as key from j) select node_id, key, content ->> ('$.\"' || key || '\"') as value, json_type(content, '$.\"' || key || '\"') in ('OBJECT', 'ARRAY') as nested from k")
def json_fields(spark, sf):
    """Fields of contents that are JSON objects, with what they hold."""
    n = table(spark, sf, "nodes").where("content like '{%'").select("node_id", "content").distinct()
    f = n.select("node_id", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))
    return f.select("node_id", "key", "value", F.coalesce(F.col("value").rlike(r"^[{\[]"), F.lit(False)).alias("nested"))


@query("usage_maps", f"with {R}, m as (select system, map_from_entries(list((k, n) order by k)) as m from (select system, k, count(*)::BIGINT as n from (select system, unnest(list_distinct(list_transform(contexts, lambda c: c.rank))) as k from r) group by 1, 2) where system is not null group by 1) select system, len(map_keys(m))::BIGINT as keys, coalesce(m[1], 0)::BIGINT as first, list_sum(map_values(m))::BIGINT as total from m")
def usage_maps(spark, sf):
    """A map of counts by the rank of a context for each system: its keys, one value and the sum."""
    c = runs(spark, sf, "system", "contexts").where("system is not null").select("system", F.explode(F.array_distinct(F.transform("contexts", lambda x: x["rank"]))).alias("k"))
    n = c.groupBy("system", "k").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("system").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))  # one entry a rank
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("system", F.size(F.map_keys("m")).cast("long").alias("keys"), F.coalesce(F.try_element_at("m", F.lit(1)), F.lit(0)).alias("first"), total.alias("total"))


@query("gold_sets", f"with {R}, g as (select id, unnest(supporting_document_ids) as d from r), h as (select id, unnest(retrieved_document_ids) as d from r) select 'both' as part, count(*)::BIGINT as n from (select * from g intersect select * from h) union all select 'missed', count(*) from (select * from g except all select * from h) union all select 'either', count(*) from (select * from g union select * from h)")
def gold_sets(spark, sf):
    """Pairs of rows and documents that are gold and retrieved, gold only (with repeats), either."""
    r = runs(spark, sf, "supporting_document_ids", "retrieved_document_ids")
    g, h = (r.select("id", F.explode(c).alias("d")) for c in ("supporting_document_ids", "retrieved_document_ids"))
    out = None
    for name, df in (("both", g.intersect(h)), ("missed", g.exceptAll(h)), ("either", g.union(h).distinct())):
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# --- reuse ------------------------------------------------------------------------------------------
@query("content_reuse", "with h as (select md5(text) as h, min(doc_id) as first, count(*)::BIGINT as n from documents where text is not null group by 1) select d.doc_id, h.first from documents d join h on h.h = md5(d.text) where h.n > 1 and d.doc_id <> h.first")
def content_reuse(spark, sf):
    """Where a document's vector can be had from: the smallest id of the same content, by its hash."""
    d = table(spark, sf, "documents").where("text is not null and doc_id is not null").select("doc_id", F.md5("text").alias("h"))
    known = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(known.drop("n"), "h").where("doc_id <> first").select("doc_id", "first")


@query("answer_backfill", f"with {R}, q as (select question, min(answers) as by_question from r where len(answers) > 0 and question is not null group by 1) select id, array_to_string(case when len(answers) > 0 then answers else by_question end, '|') as answers, case when len(answers) > 0 then 'own' when by_question is not null then 'question' else 'none' end as source from r left join q using (question)")
def answer_backfill(spark, sf):
    """Missing answers filled from the row itself, else from a row of the same question."""
    r = runs(spark, sf, "question", "answers")
    q = r.where("size(answers) > 0 and question is not null").groupBy("question").agg(F.min("answers").alias("by_question"))
    j = r.join(q, "question", "left")
    own = F.size("answers") > 0
    got = F.when(own, F.col("answers")).otherwise(F.col("by_question"))
    return j.select("id", F.array_join(got, "|").alias("answers"), F.when(own, "own").when(F.col("by_question").isNotNull(), "question").otherwise("none").alias("source"))


_FIRST = """with d as (select doc_id, lower(title) as lt, lower(coalesce(text, '')) as lx, regexp_extract(lower(title), '^[a-z0-9]+') as tok, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as xt from documents),
    xs as (select doc_id, unnest(xt) as tok from d)"""


@query("title_links_first", f"{_FIRST} select distinct least(t.doc_id, d.doc_id) as src, greatest(t.doc_id, d.doc_id) as dst from d t join xs using (tok) join d on d.doc_id = xs.doc_id where t.tok <> '' and d.doc_id <> t.doc_id and contains(d.lx, t.lt)")
def title_links_first(spark, sf):
    """Title mentions blocked on a title's first token only."""
    from evigraph.operators.substrate import title_mentions_first

    return title_mentions_first(table(spark, sf, "documents").select("doc_id", "title", "text"))


@query("title_links_directed", f"{_FIRST}, l as (select lt, max(doc_id) as doc_id, any_value(tok) as tok from d where lt is not null group by 1) select d.doc_id as src, l.doc_id as dst from l join xs using (tok) join d on d.doc_id = xs.doc_id where l.tok <> '' and d.doc_id <> l.doc_id and contains(d.lx, l.lt)")
def title_links_directed(spark, sf):
    """From the mentioning document to the last document of the title, one way."""
    from evigraph.operators.substrate import title_mentions_first

    return title_mentions_first(table(spark, sf, "documents").select("doc_id", "title", "text"), directed=True)


@query("triplet_rows", "with t as (select distinct node_id, metadata.title as h, content from nodes where content like '%: %' and metadata.title is not null), p as (select node_id, h, string_split_regex(string_split(content, chr(10))[1], ': ') as p from t) select node_id, trim(h) as h, trim(p[1]) as r, trim(p[2]) as t from p where len(p) = 2 and trim(h) <> '' and trim(p[1]) <> '' and trim(p[2]) <> '' and not contains(h || p[1] || p[2], '#') and not contains(h || p[1] || p[2], '$') and not contains(h || p[1] || p[2], '>') and not contains(h || p[1] || p[2], '<')")
def triplet_rows(spark, sf):
    """Triples out of the text form ``<h##r##t>``, made of titles and ``relation: value`` lines."""
    n = table(spark, sf, "nodes").select("node_id", F.col("metadata.title").alias("h"), "content").where("h is not null and content like '%: %'").distinct()
    p = n.withColumn("p", F.split(F.split("content", "\n")[0], ": ")).where("size(p) = 2")
    plain = ~F.concat("h", F.col("p")[0], F.col("p")[1]).rlike("[#$<>]")
    form = F.concat(F.lit("<"), "h", F.lit("##"), F.col("p")[0], F.lit("##"), F.col("p")[1], F.lit(">"))
    return p.where(plain).select("node_id", F.explode(T.triplets(form)).alias("t")).select("node_id", "t.h", "t.r", F.col("t.t").alias("t"))


@query("keyword_objects", f"with {R} select id, len(list_distinct(coalesce(answers, [])))::BIGINT as low, (question is not null)::BIGINT as high from r")
def keyword_objects(spark, sf):
    """Keywords out of a model's fenced JSON."""
    r = runs(spark, sf, "question", "answers")
    high = F.array_compact(F.array("question"))
    obj = F.to_json(F.struct(high.alias("high_level_keywords"), F.array_distinct(F.coalesce("answers", F.array().cast("array<string>"))).alias("low_level_keywords")))
    k = T.keyword_object(F.concat(F.lit("Here you are:\n```json\n"), obj, F.lit("\n```")))
    return r.select("id", F.size(k["low_level_keywords"]).cast("long").alias("low"), F.size(k["high_level_keywords"]).cast("long").alias("high"))


# --- what a user plugs in ------------------------------------------------------------------------------
_HEX = "(16 * (strpos('0123456789abcdef', substr(h, {0}, 1)) - 1) + strpos('0123456789abcdef', substr(h, {1}, 1)) - 1)"
_ENC = f"""tk as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from documents where doc_id is not null), hs as (select doc_id, md5(w) as h from tk), pl as (select doc_id, {_HEX.format(1, 2)} % 64 as d, sum(1 - 2 * ({_HEX.format(3, 4)} % 2))::DOUBLE as x from hs group by 1, 2),
    ve as (select doc_id, d, x / sqrt(nullif(sum(x * x) over (partition by doc_id), 0)) as x from pl)"""


@query("encoded_topk", f"with {_ENC}, q as (select doc_id as query_id from documents where doc_id % 100 = 0), s as (select q.query_id, b.doc_id, round(coalesce(sum(x.x * y.x), 0), 6) + 0.0 as score from q cross join documents b left join ve x on x.doc_id = q.query_id left join ve y on y.doc_id = b.doc_id and y.d = x.d group by 1, 2) select * from (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rnk, doc_id, score from s) where rnk <= 10")
def encoded_topk(spark, sf):
    """Dense search over texts by a plugged-in encoder, here the hashed stand-in."""
    from evigraph.interfaces import retrieve

    d = table(spark, sf, "documents").select("doc_id", "text")
    return retrieve("hashed", d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"), d, 10)


@query("mock_reader", f"with {R} select id, array_to_string(list_filter(string_split_regex(string_split(coalesce(contexts[1].text, ''), chr(10))[1], '[\\s]+'), lambda x: x <> '')[1:5], ' ') as answer from r where len(contexts) > 0 and question is not null")
def mock_reader(spark, sf):
    """Prompts answered by a plugged-in model, here one that repeats the first context."""
    from evigraph.interfaces import ExtractiveModel, generate

    r = runs(spark, sf, "question", "contexts").where("size(contexts) > 0 and question is not null")
    return generate(r.select("id", T.prompt(F.col("question"), F.col("contexts")).alias("prompt")), "id", "prompt", ExtractiveModel())
