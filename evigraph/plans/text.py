"""Lexical retrieval, text functions and document ETL over ``documents``.

Queries of searches are the documents whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import fusion, lexical, metrics, partition
from evigraph.plans.registry import query
from evigraph.session import cut
from evigraph.sources.tables import table


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def asked(spark, sf) -> DataFrame:
    return docs(spark, sf).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


# White space of both engines' patterns: blank, tab, line ends, vertical tab, form feed.
TOK = r"tk as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as t from documents)"
POST = TOK + ", po as (select doc_id, term, count(*) as tf, any_value(len) as len from (select doc_id, len(t) as len, unnest(t) as term from tk) group by doc_id, term)"
STAT = "st as (select count(*) as n, avg(len(t)) as avgdl from tk)"
IDF = "i0 as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from po, st group by term), idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from i0) else raw end as idf from i0)"
RANK = "row_number() over (partition by query_id order by score desc, doc_id)"
BM = f"""qt as (select doc_id as query_id, term, tf as qtf from po where doc_id % 100 = 0), bs as (select query_id, po.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) as score
    from qt join po using (term) join idf using (term), st group by 1, 2), bm as (select query_id, {RANK} as rnk, doc_id, score from bs)"""


@query("bm25_index", f"with {POST}, {STAT}, {IDF} select term, df, round(idf, 6) as idf from idf")
def bm25_index(spark, sf):
    d = docs(spark, sf)
    return lexical.idf(lexical.postings(d), lexical.corpus_stats(d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"with {POST}, {STAT}, {IDF}, {BM} select * from bm where rnk <= 20")
def bm25_topk(spark, sf):
    return lexical.bm25(asked(spark, sf), docs(spark, sf), 20)


@query("bm25_filled", f"with {POST}, {STAT}, {IDF}, {BM}, fl as (select query_id, doc_id, score, 0 as z from bm where rnk <= 200 union all select a.doc_id, b.doc_id, 0, 1 from (select doc_id from documents where doc_id % 100 = 0) a, documents b where not exists (select 1 from bs where bs.query_id = a.doc_id and bs.doc_id = b.doc_id)) select * from (select query_id, row_number() over (partition by query_id order by z, score desc, doc_id) as rnk, doc_id, score::DOUBLE as score from fl) where rnk <= 200")
def bm25_filled(spark, sf):
    return lexical.bm25_filled(asked(spark, sf), docs(spark, sf), 200)


SPARSE = """sv0 as (select doc_id, term, round(ln(1 + tf) * ln(1 + n / df), 9) as w from po join i0 using (term), st), sv1 as (select *, row_number() over (partition by doc_id order by w desc, term) as r from sv0), sv as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from sv1 where r <= 64)"""


@query("sparse_topk", f"with {POST}, {STAT}, {IDF}, {SPARSE}, s as (select a.doc_id as query_id, b.doc_id, round(sum(a.w * b.w), 6) as score from sv a join sv b using (term) where a.doc_id % 100 = 0 and a.doc_id <> b.doc_id group by 1, 2) select * from (select query_id, {RANK} as rnk, doc_id, score from s where score > 0) where rnk <= 20")
def sparse_topk(spark, sf):
    return lexical.sparse_search(docs(spark, sf), "doc_id % 100 = 0", 20, exclude_self=True)


QS = """qd as (select distinct query_id, term from qt), sl as (select term, greatest(0, ln(n - df + 0.5) - ln(df + 0.5)) / ln(n + 1) as s from i0, st), qs as (select query_id, count(*)::BIGINT as n_terms, round(count(s) / count(*), 6) as coverage, round(avg(s), 6) as mean, round(quantile_cont(s, 0.5), 6) as median, round(max(s), 6) as max, round(min(s), 6) as min from qd left join sl using (term) group by 1),
    qa as (select a.doc_id as query_id, coalesce(n_terms, 0) as n_terms, coalesce(coverage, 0) as coverage, mean, median, max, min from (select doc_id from documents where doc_id % 100 = 0) a left join qs on qs.query_id = a.doc_id)"""
ROUTE = "case when coalesce(median, 0) >= 0.55 then 'lexical' when coalesce(median, 0) <= 0.35 then 'dense' else 'hybrid' end as route"


@query("idf_stats", f"with {POST}, {STAT}, {IDF}, {BM}, {QS} select * from qa")
def idf_stats(spark, sf):
    return lexical.idf_stats(asked(spark, sf), docs(spark, sf))


@query("selectivity_route", f"with {POST}, {STAT}, {IDF}, {BM}, {QS} select query_id, median, {ROUTE} from qa")
def selectivity_route(spark, sf):
    return lexical.route(idf_stats(spark, sf)).select("query_id", "median", "route")


@query("selectivity_retrieve", f"""with {POST}, {STAT}, {IDF}, {BM}, {QS}, {SPARSE}, ro as (select query_id, {ROUTE} from qa), ss as (select a.doc_id as query_id, b.doc_id, round(sum(a.w * b.w), 6) as score from sv a join sv b using (term) where a.doc_id % 100 = 0 group by 1, 2), sp as (select * from (select query_id, {RANK} as rnk, doc_id, score from ss where score > 0) where rnk <= 50), bt as (select * from bm where rnk <= 50),
    hy as (select query_id, doc_id, round(sum(1.0 / (60 + rnk)), 9) as score from (select * from bt union all select * from sp) group by 1, 2), al as (select route, query_id, rnk, doc_id from bt join ro using (query_id) where route = 'lexical' union all select route, query_id, rnk, doc_id from sp join ro using (query_id) where route = 'dense' union all select route, query_id, rnk, doc_id from (select query_id, {RANK} as rnk, doc_id from hy) join ro using (query_id) where route = 'hybrid') select route, query_id, rnk, doc_id from al where rnk <= 10""")
def selectivity_retrieve(spark, sf):
    """Each query by its own route: terms, tf-idf vectors as the dense stand-in, or both fused."""
    ro = cut(selectivity_route(spark, sf).select("query_id", "route"))
    b = cut(lexical.bm25(asked(spark, sf), docs(spark, sf), 50))  # both lists are used twice, the routes three times
    s = cut(lexical.sparse_search(docs(spark, sf), "doc_id % 100 = 0", 50))
    h = fusion.rrf({"b": b, "s": s})
    pick = lambda df, r: df.select("query_id", "rnk", "doc_id").join(ro.where(F.col("route") == r), "query_id")
    out = pick(b, "lexical").unionByName(pick(s, "dense")).unionByName(pick(h, "hybrid"))
    return out.where("rnk <= 10").select("route", "query_id", "rnk", "doc_id")


@query("scoped_bm25", f"with {POST}, {STAT}, {IDF}, {BM} select * from (select query_id, {RANK} as rnk, doc_id, score from bs join documents a on a.doc_id = query_id join documents b on b.doc_id = bs.doc_id where a.source = b.source) where rnk <= 10".replace("partition by query_id order by score desc, doc_id", "partition by query_id order by score desc, bs.doc_id").replace("rnk, doc_id, score from bs join", "rnk, bs.doc_id, score from bs join"))
def scoped_bm25(spark, sf):
    """Lexical ranking inside the query's own source only."""
    src = table(spark, sf, "documents").where("source is not null").select("doc_id", F.col("source").alias("scope"))
    return lexical.bm25(asked(spark, sf), docs(spark, sf), 10, (src.withColumnRenamed("doc_id", "query_id"), src))


@query("dedup_exact", "select doc_id, title, text from (select *, row_number() over (partition by coalesce(title, ''), title is null, md5(coalesce(text, '')), text is null order by doc_id) as r from documents) where r = 1")
def dedup_exact(spark, sf):
    """First document of each (title, md5 of the text); a null equals a null."""
    d = table(spark, sf, "documents").select("doc_id", "title", "text")
    # the smallest id of a group is an aggregate, so a group of copies is combined map-side
    k = F.struct("title", F.md5(F.col("text")).alias("h"))
    first = d.groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return d.join(first, "doc_id", "left_semi")


@query("content_hash", "select doc_id, md5(coalesce(text, '')) as h, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ')) as squeezed from documents")
def content_hash(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select("doc_id", F.md5(t).alias("h"), F.md5(F.trim(F.regexp_replace(t, r"\s+", " "))).alias("squeezed"))


@query("chunk_partition", "select doc_id, ((row_number() over (order by doc_id) - 1) // 200)::BIGINT as pid from documents")
def chunk_partition(spark, sf):
    return partition.chunks(table(spark, sf, "documents").select("doc_id"), "doc_id", 200)


@query("source_chain", "select * from (select source, lag(doc_id) over (partition by source order by doc_id) as src, doc_id as dst from documents) where src is not null")
def source_chain(spark, sf):
    """Consecutive documents of a source, as paragraphs of an article are chained."""
    d = partition.in_groups(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")
    return d.select("source", F.col("prev").alias("src"), F.col("doc_id").alias("dst")).where("src is not null")


@query("answer_normalise", r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) as norm from documents""")
def answer_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normal_answer(F.col("title")).alias("norm"))


@query("title_or_id", "select doc_id, coalesce(nullif(trim(title), ''), doc_id::VARCHAR) as name from documents")
def title_or_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.title_or_id(F.col("title"), F.col("doc_id")).alias("name"))


@query("alnum_tokens", "select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::BIGINT as n, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')))::BIGINT as distinct_n from documents")
def alnum_tokens(spark, sf):
    t = T.alnum(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("distinct_n"))


@query("split_assign", "with h as (select doc_id, row_number() over (order by md5(doc_id::VARCHAR), doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, case when i < floor(0.7 * n) then 'train' when i < floor(0.7 * n) + floor(0.2 * n) then 'val' else 'test' end as split from h")
def split_assign(spark, sf):
    """70/20/10 by the order of a hash of the id."""
    return partition.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("doc_fingerprint", "select source, sum(('0x' || substr(md5(doc_id::VARCHAR || '|' || coalesce(title, '') || '|' || coalesce(text, '')), 1, 15))::HUGEINT)::VARCHAR as fingerprint, count(*)::BIGINT as docs from documents group by source")
def doc_fingerprint(spark, sf):
    """Content-addressed fingerprint per source, whatever the order of its rows: the sum of the rows'
    hashes, 60 bits each, which combines map-side."""
    row = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    d = table(spark, sf, "documents").select("source", F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    return d.groupBy("source").agg(F.sum("h").cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("docs"))


@query("token_budget", f"""with {TOK}, c as (select d.source as query_id, d.doc_id, len(t) as tokens, row_number() over (partition by d.source order by d.doc_id) as rnk from tk join documents d using (doc_id)), b as (select *, coalesce(sum(tokens) over (partition by query_id order by rnk rows between unbounded preceding and 1 preceding), 0) as before from c)
    select query_id, rnk, doc_id, tokens::BIGINT as tokens, least(tokens, 2000 - before)::BIGINT as kept from b where least(tokens, 2000 - before) > 0""")
def token_budget(spark, sf):
    """Documents of a source, in order of their ids, as contexts within 2,000 tokens."""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))
    d = partition.in_groups(d, "query_id", "doc_id", "tokens").withColumn("kept", F.least("tokens", F.lit(2000) - (F.col("upto") - F.col("tokens"))))
    return d.where("kept > 0").select("query_id", (F.col("idx") + 1).cast("long").alias("rnk"), "doc_id", "tokens", "kept")


@query("tree_select", f"""with {TOK}, c as (select d.source as query_id, d.doc_id, len(t) as tokens, row_number() over (partition by d.source order by d.doc_id) as rnk from tk join documents d using (doc_id)), b as (select *, sum(tokens) over (partition by query_id order by rnk) as upto from c)
    select query_id, rnk, doc_id from b where upto <= 2000""")
def tree_select(spark, sf):
    """Nodes in order until the first that would exceed the budget."""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", F.size(T.tokens(F.col("text"))).alias("tokens"))
    d = partition.in_groups(d, "query_id", "doc_id", "tokens")
    return d.where("upto <= 2000").select("query_id", (F.col("idx") + 1).cast("long").alias("rnk"), "doc_id")


@query("context_format", "with c as (select source, doc_id, title, text, row_number() over (partition by source order by doc_id) as r from documents) select source, string_agg('[' || r || '] ' || coalesce(title, '') || ': ' || substring(coalesce(text, ''), 1, 1800), chr(10) order by r) as context from c where r <= 5 group by source")
def context_format(spark, sf):
    """Prompt context of the first five documents of each source, each cut at 1,800 characters."""
    d = table(spark, sf, "documents").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("r <= 5")
    line = F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 1800))
    return d.groupBy("source").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"])).alias("context"))


@query("entity_edges", f"""with {POST}, sh as (select term as entity, count(*) as df from po where regexp_matches(term, '^[a-z]{{5,}}$') group by 1 having count(*) between 2 and 25) select a.doc_id as src, b.doc_id as dst, round(sum(1.0 / df), 9)::DOUBLE as w from po a join po b using (term) join sh on sh.entity = term where a.doc_id <> b.doc_id group by 1, 2""")
def entity_edges(spark, sf):
    """Documents that share rare words, as the stand-in for named entities."""
    from evigraph.operators.graph import shared_entity

    p = lexical.postings(docs(spark, sf)).where(F.col("term").rlike("^[a-z]{5,}$")).select("doc_id", F.col("term").alias("entity"))
    return shared_entity(p)


@query("title_links", """with d as (select doc_id, lower(title) as lt, lower(coalesce(text, '')) as lx, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) as tt, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as xt from documents),
    df as (select tok, count(*) as df from (select unnest(xt) as tok from d) group by tok),
    ti as (select doc_id, lt, tt from d where lt is not null and regexp_full_match(string_split(lt, ' ')[1], '[a-z0-9]+') and len(tt) > 0),
    ra as (select doc_id, arg_min(tok, (coalesce(df.df, 0), tok)) as tok from (select doc_id, unnest(tt) as tok from ti) left join df using (tok) group by doc_id),
    xs as (select doc_id, unnest(xt) as tok from d)
    select distinct least(ti.doc_id, d.doc_id) as src, greatest(ti.doc_id, d.doc_id) as dst from ra join ti using (doc_id) join xs on xs.tok = ra.tok join d on d.doc_id = xs.doc_id where d.doc_id <> ti.doc_id and list_has_all(d.xt, ti.tt) and contains(d.lx, ti.lt)""")
def title_links(spark, sf):
    """Title mentions, blocked on the rarest token of the title: every title token must occur in the
    text, and the title as a substring. The join carries ids and tokens; texts are fetched for the
    pairs that are left. A token that many titles have as their rarest is split by the skew join."""
    from evigraph.operators.substrate import title_mentions

    return title_mentions(table(spark, sf, "documents").select("doc_id", "title", "text"))


@query("pool_narrow", f"""with {POST}, {STAT}, {IDF}, {BM}, p as (select * from bm where rnk <= 30), ch as (select * from (select lag(doc_id) over (partition by source order by doc_id) as src, doc_id as dst from documents) where src is not null), ed as (select src, dst from ch union select dst, src from ch)
    select query_id, count(distinct doc_id)::BIGINT as pool, count(distinct doc_id) filter (where k = 0)::BIGINT as narrowed from (select query_id, doc_id, 0 as k from p union all select query_id, ed.dst, 1 from p join ed on ed.src = p.doc_id) group by 1""")
def pool_narrow(spark, sf):
    """A narrowed pool (30 best by terms) and that pool with its one-hop neighbours."""
    from evigraph.operators.graph import mirror

    p = cut(lexical.bm25(asked(spark, sf), docs(spark, sf), 30).select("query_id", "doc_id"))  # used twice
    e = mirror(source_chain(spark, sf).select("src", "dst"))
    near = p.join(e, p["doc_id"] == e["src"]).select("query_id", F.col("dst").alias("doc_id"), F.lit(1).alias("k"))
    both = p.withColumn("k", F.lit(0)).unionByName(near).distinct()
    return both.groupBy("query_id").agg(F.count_distinct("doc_id").alias("pool"), F.count_distinct(F.when(F.col("k") == 0, F.col("doc_id"))).alias("narrowed"))


_BLANK = "[\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}]"
_SQUEEZE = f"trim(regexp_replace(x, '{_BLANK}+', ' ', 'g'))"


@query("sentence_split", f"""with t as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\\r\\n?', chr(10), 'g') as x from documents),
    s as (select doc_id, list_filter(list_transform(case when regexp_matches(x, '{_BLANK}{{2,}}') then string_split_regex(x, '{_BLANK}{{2,}}') else string_split(regexp_replace(x, '([.!?]){_BLANK}+([A-Z0-9"\'\'])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) end, lambda x: {_SQUEEZE}), lambda x: x <> '') as p from t)
    select doc_id, (unnest(range(len(p))))::BIGINT as pos, unnest(p) as sentence from s""")
def sentence_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_NAMES = "[A-Z][\\pL\\pN_.\'\'\u2019&:\\-]*(?:\\s+(?:[A-Z][\\pL\\pN_.\'\'\u2019&:\\-]*|of|the|to|de|for|a|an|in|\\([^)]*\\)))*"


@query("query_decompose", f"""with q as (select distinct query_id, text from queries where query_id is not null and text is not null),
    p as (select query_id, text, [text] || list_filter(list_transform(regexp_extract_all(text, '\\[([^\\]]+)\\]', 1), lambda x: trim(x)), lambda x: x <> '') || list_filter(list_transform(flatten(list_transform(string_split_regex(text, '{T.PART}'), lambda f: regexp_extract_all(f, '{_NAMES}'))), lambda x: trim(regexp_replace(trim(x), '{T.LEAD}', ''))), lambda x: len(x) > 2 and lower(x) not in {T.NO_QUERY}) as parts from q),
    e as (select query_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from p), d as (select query_id, part, min(i) as i from e group by 1, 2)
    select query_id, part, row_number() over (partition by query_id order by i) - 1 as pos from d""")
def query_decompose(spark, sf):
    q = table(spark, sf, "queries").select("query_id", "text").where("text is not null and query_id is not null").dropDuplicates(["query_id"])
    return q.select("query_id", F.posexplode(T.decompose(F.col("text"))).alias("pos", "part"))


@query("corpus_by_lang", "select lower(substring(coalesce(lang, 'und'), 1, 2)) as lang, kind, count(*)::BIGINT as docs, sum(length(coalesce(text, '')))::BIGINT as chars from documents group by grouping sets ((1, 2), (1), ())")
def corpus_by_lang(spark, sf):
    d = table(spark, sf, "documents").select(F.lower(F.substring(F.coalesce("lang", F.lit("und")), 1, 2)).alias("lang"), "kind", F.length(F.coalesce("text", F.lit(""))).alias("c"))
    return d.rollup("lang", "kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("c").alias("chars"))


@query("label_agreement", "with r as (select source, (length(coalesce(text, '')) > 250)::INT as a, (n_chars > 250)::INT as b from documents), g as (select source, count(*) as n, count(*) filter (where a = b) as agree, avg(a) as p, avg(b) as q from r where a is not null and b is not null group by grouping sets ((source), ())) select source, n::BIGINT as n, agree::BIGINT as agree, round(agree / n, 6) as agreement, case when p * q + (1 - p) * (1 - q) < 1 then round((agree / n - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) end as kappa from g")
def label_agreement(spark, sf):
    """Two raters of whether a text is long, by its characters and by its recorded length: agreement
    and kappa pooled and per source, in one pass."""
    from evigraph.functions.stats import kappa

    r = table(spark, sf, "documents").select("source", (F.length(F.coalesce("text", F.lit(""))) > 250).cast("int").alias("a"), (F.col("n_chars") > 250).cast("int").alias("b"))
    both = r.select(F.explode(F.array(F.struct("source", F.lit(0).alias("g")), F.struct(F.lit(None).cast("string").alias("source"), F.lit(1).alias("g")))).alias("k"), "a", "b")
    return kappa(both.select("k.source", "k.g", "a", "b"), ["source", "g"], "a", "b").drop("g")


@query("half_up_percent", "select source, count(*)::BIGINT as n, count(*) filter (where title is null)::BIGINT as untitled, floor(100.0 * count(*) filter (where title is null) / count(*) + 0.5)::BIGINT as percent from documents group by source")
def half_up_percent(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title").isNull()).alias("untitled"))
    return d.withColumn("percent", F.floor(100 * F.col("untitled") / F.col("n") + 0.5).cast("long"))
