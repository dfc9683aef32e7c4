"""Building the substrate: title mentions, audits, canonical edges, questions and their golds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import alnum


def title_mentions(docs: DataFrame) -> DataFrame:
    """``(src, dst)`` with src < dst: one document's title occurs in the other's text.

    Counted are titles whose first blank-parted word is made of ``[a-z0-9]`` in lower case. Null
    titles or texts mention nothing and aren't mentioned. Copies of a title are folded before the
    join, so a title that a tenth of the documents bear is searched once; its pairs are expanded
    at the end, for they are the result."""
    d = docs.where("doc_id is not null")
    lt = F.lower("title")
    own = d.where(lt.isNotNull() & F.element_at(F.split(lt, " "), 1).rlike("^[a-z0-9]+$")).select("doc_id", lt.alias("lt"))
    titles = own.select("lt").distinct().select("lt", F.array_distinct(alnum(F.col("lt"))).alias("tt"))
    text = d.where("text is not null").select(F.col("doc_id").alias("other"), F.lower("text").alias("lx"))
    bag = text.select("other", F.array_distinct(alnum(F.col("lx"))).alias("xt"))
    words = bag.select("other", F.explode("xt").alias("tok"))
    df = words.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rare = titles.select("lt", F.explode("tt").alias("tok")).join(df, "tok", "left").groupBy("lt").agg(F.min_by("tok", F.struct(F.coalesce("df", F.lit(0)), "tok")).alias("tok"))
    pairs = rare.join(words, "tok").select("lt", "other")
    full = pairs.join(titles, "lt").join(bag, "other").where(F.size(F.array_except("tt", "xt")) == 0).select("lt", "other")
    hits = full.join(text, "other").where(F.col("lx").contains(F.col("lt"))).select("lt", "other")
    links = hits.join(own, "lt").where("doc_id <> other")
    return links.select(F.least("doc_id", "other").alias("src"), F.greatest("doc_id", "other").alias("dst")).distinct()


def title_mentions_first(docs: DataFrame, directed: bool = False) -> DataFrame:
    """``(src, dst)``: one document's title occurs in the other's text, blocked on the title's first
    token alone. Undirected with src < dst; ``directed`` leads from the mentioning document to the
    largest id of those that bear the title. Titles that don't start with ``[a-z0-9]`` in lower case
    are left out. Copies of a title are searched once."""
    d = docs.where("doc_id is not null")
    own = d.where("title is not null").select("doc_id", F.lower("title").alias("lt")).withColumn("tok", F.regexp_extract("lt", "^[a-z0-9]+", 0)).where("tok <> ''")
    titles = own.groupBy("lt").agg(F.first("tok").alias("tok"), F.max("doc_id").alias("last"))
    text = d.where("text is not null").select(F.col("doc_id").alias("other"), F.lower("text").alias("lx"))
    words = text.select("other", F.explode(F.array_distinct(alnum(F.col("lx")))).alias("tok"))
    hits = titles.join(words, "tok").join(text, "other").where(F.col("lx").contains(F.col("lt"))).select("lt", "last", "other")
    if directed:
        return hits.where("last <> other").select(F.col("other").alias("src"), F.col("last").alias("dst"))
    links = hits.join(own.select("lt", "doc_id"), "lt").where("doc_id <> other")
    return links.select(F.least("doc_id", "other").alias("src"), F.greatest("doc_id", "other").alias("dst")).distinct()


def question_golds(nodes: DataFrame) -> DataFrame:
    """``(query_id, doc_id)``: the neighbours of questions that are corpus nodes."""
    q = nodes.where("type = 'question'").select(F.col("node_id").alias("query_id"), F.explode(F.array_distinct("neighbors")).alias("doc_id"))
    corpus = nodes.where("coalesce(type, '') <> 'question'").select(F.col("node_id").alias("doc_id"))
    return q.join(corpus, "doc_id", "left_semi").select("query_id", "doc_id")
