"""Readers of the public question-answering formats into one node table, and sinks.

A node is ``(node_id, content, metadata STRUCT<source, type, title, split, hop, is_impossible>,
neighbors)``. Readers give explicit schemas, so nothing is inferred by an extra pass; the order that
ids need comes from the records' own positions, never from the row order of a shuffle."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.text import content_key, relation_label
from evigraph.session import attach

META = "source string, type string, title string, split string, hop int, is_impossible boolean"
NODE = f"node_id string, content string, metadata struct<{META.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>, neighbors array<string>"


def node(ident: Column, content: Column, source: str, kind: str, title: Column | None = None, neighbors: Column | None = None, hop: Column | None = None, impossible: Column | None = None, split: Column | None = None) -> list[Column]:
    null = lambda t: F.lit(None).cast(t)
    meta = F.struct(
        F.lit(source).alias("source"), F.lit(kind).alias("type"), (title if title is not None else null("string")).alias("title"),
        (split if split is not None else null("string")).alias("split"), (hop if hop is not None else null("int")).cast("int").alias("hop"),
        (impossible if impossible is not None else null("boolean")).alias("is_impossible"),
    )
    empty = F.array().cast("array<string>")
    return [ident.alias("node_id"), content.alias("content"), meta.alias("metadata"), (F.coalesce(neighbors, empty) if neighbors is not None else empty).alias("neighbors")]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a JSON array or of JSON lines."""
    return attach(spark).read.schema(NODE).option("multiLine", _is_array(spark, path)).json(path)


def _is_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.substring(F.ltrim("value"), 1, 1)).first()
    return bool(first and first[0] == "[")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return attach(spark).read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = attach(spark).read.option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


def read_squad(spark: SparkSession, path: str, source: str = "squad") -> DataFrame:
    """Articles of paragraphs with questions; consecutive paragraphs of an article are chained."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string>>>>>>>>"
    raw = attach(spark).read.schema(schema).option("multiLine", True).json(path)
    a = raw.select(F.posexplode("data").alias("a", "x")).select("a", "x.title", F.posexplode("x.paragraphs").alias("p", "y"))
    doc = F.format_string(f"{source}_doc_%d_%d", "a", "p")
    w = W.partitionBy("a").orderBy("p")
    docs = a.select("title", "y.context", doc.alias("id"), F.array_compact(F.array(F.lag(doc).over(w), F.lead(doc).over(w))).alias("near"))
    q = a.select(doc.alias("doc"), F.explode("y.qas").alias("q"))
    return docs.select(*node(F.col("id"), F.col("context"), source, "document", F.col("title"), F.col("near"))).unionByName(
        q.select(*node(F.concat(F.lit(f"{source}_q_"), "q.id"), F.col("q.question"), source, "question", None, F.array("doc"), impossible=F.col("q.is_impossible")))
    )


def _articles(rows: DataFrame, source: str) -> DataFrame:
    """``rows (qid, ord, pos, title, text, gold)``: documents deduplicated by title, the first record
    wins; questions point at their gold titles."""
    first = rows.groupBy("title").agg(F.min(F.struct("ord", "pos", "text")).alias("f"))
    return first.select("title", F.col("f.text").alias("text"), F.concat(F.lit(f"{source}_doc_"), F.md5("title")).alias("id"))


def read_hotpot(spark: SparkSession, path: str, source: str = "hotpotqa") -> DataFrame:
    """JSON lines or one JSON array, contexts as ``{title: [], sentences: [[]]}`` and supporting facts
    as ``{title: []}``; documents are deduplicated by title, golds are titles of the own context."""
    schema = "id string, _id string, question string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>"
    raw = attach(spark).read.schema(schema).option("multiLine", _is_array(spark, path)).json(path)
    q = raw.select(F.coalesce("_id", "id").alias("qid"), "question", "context", F.col("supporting_facts.title").alias("gold"))
    p = q.select("qid", "question", "gold", F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("pos", "c"))
    rows = p.select("qid", F.col("qid").alias("ord"), "pos", F.col("c.title").alias("title"), F.concat_ws(" ", "c.sentences").alias("text"), F.array_contains("gold", F.col("c.title")).alias("g"))
    docs = _articles(rows, source)
    gold = rows.where("g").join(docs.select("title", "id"), "title").groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("golds"))  # one context's titles
    qs = q.select("qid", "question").join(gold, "qid", "left")
    return docs.select(*node(F.col("id"), F.col("text"), source, "document", F.col("title"))).unionByName(
        qs.select(*node(F.concat(F.lit(f"{source}_q_"), "qid"), F.col("question"), source, "question", None, F.col("golds")))
    )


def read_paragraphs(spark: SparkSession, path: str, source: str = "musique") -> DataFrame:
    """JSON lines with ``paragraphs [{idx, title, paragraph_text, is_supporting}]``: the corpus is the
    union of all paragraphs deduplicated by title and text; golds are the supporting ones."""
    schema = "id string, question string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    raw = attach(spark).read.schema(schema).json(path)
    p = raw.select("id", F.explode("paragraphs").alias("p")).select("id", "p.*").withColumn("doc", F.concat(F.lit(f"{source}_doc_"), F.md5(F.concat_ws("\n", "title", "paragraph_text"))))
    docs = p.groupBy("doc").agg(F.first("title").alias("title"), F.first("paragraph_text").alias("text"))
    gold = p.where("is_supporting").groupBy("id").agg(F.array_sort(F.collect_set("doc")).alias("golds"))
    qs = raw.select("id", "question").join(gold, "id", "left")
    return docs.select(*node(F.col("doc"), F.col("text"), source, "document", F.col("title"))).unionByName(
        qs.select(*node(F.concat(F.lit(f"{source}_q_"), "id"), F.col("question"), source, "question", None, F.col("golds")))
    )


def read_wrapped(spark: SparkSession, path: str, source: str = "musique") -> DataFrame:
    """JSON lines whose paragraphs lie under ``paragraphs`` or ``metadata.paragraphs``, as lists of
    sentences under ``metadata.context.content``, or as texts of Python literals under
    ``metadata.question_decomposition[].support_paragraph``, which all support the question. Every
    paragraph with a text is a document of its own; question and support are neighbours. Literals that
    can't be read are passed over."""

    def one(line: str) -> Iterator[tuple]:
        row = json.loads(line)
        meta = row.get("metadata") or {}
        ps = row.get("paragraphs") or meta.get("paragraphs") or []
        if not ps and isinstance(meta.get("context"), dict):
            ps = [{"paragraph_text": " ".join(c) if isinstance(c, list) else c} for c in meta["context"].get("content") or []]
        elif not ps:
            for step in meta.get("question_decomposition") or []:
                p = step.get("support_paragraph")
                try:
                    p = ast.literal_eval(p) if isinstance(p, str) and p else p
                except (ValueError, SyntaxError):
                    continue
                if isinstance(p, dict):
                    ps.append({"is_supporting": True, **p})
        qid = str(row.get("id", "unknown"))
        yield qid, row.get("question") or "", -1, None, None, False
        for i, p in enumerate(ps):
            text = (p.get("paragraph_text") or p.get("content")) if isinstance(p, dict) else None
            if text:
                yield qid, None, i, p.get("title") or "", text, bool(p.get("is_supporting", False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [r for line in batch.column(0).to_pylist() if line and line.strip() for r in one(line)]
            cols = list(zip(*got)) if got else [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["qid", "question", "i", "title", "text", "gold"])

    rows = attach(spark).read.text(path).mapInArrow(run, "qid string, question string, i int, title string, text string, gold boolean")
    doc, q = F.format_string(f"{source}_doc_%s_%d", "qid", "i"), F.concat(F.lit(f"{source}_q_"), "qid")
    gold = rows.where("gold").groupBy("qid").agg(F.array_sort(F.collect_list(doc)).alias("golds"))  # one question's support
    docs = rows.where("i >= 0").select(*node(doc, F.col("text"), source, "document", F.col("title"), F.when(F.col("gold"), F.array(q)).otherwise(F.array().cast("array<string>"))))
    return docs.unionByName(rows.where("i < 0").join(gold, "qid", "left").select(*node(q, F.col("question"), source, "question", None, F.col("golds"))))


def read_view(spark: SparkSession, path: str, kind: str, least: int = 2, exact: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents (doc_key, title, text), queries (query_id, text, golds))`` of a view that is
    reviewed: documents by their content, golds by the documents' keys.

    ``kind`` is ``titles`` (parquet with JSON texts ``context [[title, [sentences]]]`` and
    ``supporting_facts [[title, n]]``), ``paragraphs`` (JSON lines with ``is_supporting``) or ``lists``
    (JSON lines ``context {title, sentences}``, ``supporting_facts {title}``). A query whose support
    isn't all among its context, or comes to fewer than ``least`` documents (or not to ``exact``), is
    an error that names how many there are."""
    attach(spark)
    if kind == "titles":
        raw = spark.read.parquet(path).select(F.col("_id").cast("string").alias("qid"), "question", F.from_json("context", "array<array<string>>").alias("c"), F.from_json("supporting_facts", "array<array<string>>").alias("s"))
        rows = raw.select("qid", "question", F.array_distinct(F.transform("s", lambda x: x[0])).alias("wanted"), F.posexplode("c").alias("pos", "c"))
        rows = rows.select("qid", "question", "wanted", "pos", F.col("c")[0].alias("title"), F.array_join(F.from_json(F.col("c")[1], "array<string>"), " ").alias("text"))
    elif kind == "lists":
        raw = spark.read.schema("id string, question string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>").json(path)
        rows = raw.select(F.col("id").alias("qid"), "question", F.array_distinct("supporting_facts.title").alias("wanted"), F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("pos", "c"))
        rows = rows.select("qid", "question", "wanted", "pos", F.col("c.title").alias("title"), F.array_join("c.sentences", " ").alias("text"))
    elif kind == "paragraphs":
        raw = spark.read.schema("id string, question string, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>").json(path)
        rows = raw.select(F.col("id").alias("qid"), "question", F.posexplode("paragraphs").alias("pos", "p"))
        rows = rows.select("qid", "question", F.lit(None).cast("array<string>").alias("wanted"), "pos", F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.paragraph_text").alias("text"), F.col("p.is_supporting").alias("own"))
    else:
        raise ValueError(f"no kind {kind}")
    rows = rows.withColumn("key", content_key(F.col("title"), F.col("text")))
    # of several paragraphs of one title in a context the last stands for it
    last = F.row_number().over(W.partitionBy("qid", "title").orderBy(F.desc("pos"))) == 1
    rows = rows.withColumn("gold", F.coalesce(F.col("own"), F.lit(False)) if kind == "paragraphs" else F.array_contains("wanted", F.col("title")) & last)
    q = rows.groupBy("qid").agg(F.first("question").alias("text"), F.array_sort(F.collect_set(F.when(F.col("gold"), F.col("key")))).alias("golds"), F.first(F.size("wanted")).alias("n"))  # one context
    wrong = (F.size("golds") != exact) if exact else (F.size("golds") < least) | (F.coalesce("n", F.lit(-1)).cast("int").between(0, 1 << 30) & (F.size("golds") != F.col("n")))
    bad = q.where(wrong)
    some = [r.qid for r in bad.orderBy("qid").limit(3).collect()]
    if some:
        raise ValueError(f"{bad.count()} queries with invalid support; the first are {some}")
    docs = rows.groupBy(F.col("key").alias("doc_key")).agg(F.min_by(F.struct("title", "text"), F.struct("qid", "pos")).alias("d")).select("doc_key", "d.*")
    return docs, q.select(F.col("qid").alias("query_id"), "text", "golds")


def read_contexts(spark: SparkSession, path: str, source: str = "2wiki") -> DataFrame:
    """JSON lines with ``context [[title, [sentences]]]`` as strings in ``title`` and ``sentences``
    arrays; every context paragraph is a document of its own, without deduplication."""
    schema = "_id string, question string, titles array<string>, texts array<string>, supporting array<string>"
    raw = attach(spark).read.schema(schema).json(path)
    p = raw.select("_id", "supporting", F.posexplode(F.arrays_zip("titles", "texts")).alias("i", "c"))
    doc = F.format_string(f"{source}_doc_%s_%d", "_id", "i")
    docs = p.select(*node(doc, F.col("c.texts"), source, "document", F.col("c.titles")))
    gold = p.where(F.array_contains("supporting", F.col("c.titles"))).groupBy("_id").agg(F.array_sort(F.collect_list(doc)).alias("golds"))
    qs = raw.select("_id", "question").join(gold, "_id", "left")
    return docs.unionByName(qs.select(*node(F.concat(F.lit(f"{source}_q_"), "_id"), F.col("question"), source, "question", None, F.col("golds"))))


def read_triples(spark: SparkSession, path: str, source: str = "metaqa", most: int = 10) -> DataFrame:
    """Lines ``subject|relation|object``: a document per entity, whose content is up to ``most`` triple
    sentences, those with it as the subject first; neighbours are the entities tied to it."""
    t = attach(spark).read.text(path).select(F.split("value", r"\|").alias("p")).where(F.size("p") == 3)
    t = t.select(F.col("p")[0].alias("s"), F.col("p")[1].alias("r"), F.col("p")[2].alias("o")).distinct()
    say = F.concat_ws(" ", "s", F.replace("r", F.lit("_"), F.lit(" ")), "o")
    both = t.select(F.col("s").alias("e"), F.lit(0).alias("k"), say.alias("x"), F.col("o").alias("n")).unionByName(t.select(F.col("o").alias("e"), F.lit(1).alias("k"), say.alias("x"), F.col("s").alias("n")))
    w = W.partitionBy("e").orderBy("k", "x")
    top = both.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most)
    text = top.groupBy("e").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"])).alias("content"))
    ident = lambda c: F.concat(F.lit(f"{source}_ent_"), c)
    near = both.where("e <> n").groupBy("e").agg(F.array_sort(F.collect_set(ident(F.col("n")))).alias("near"))
    return text.join(near, "e", "left").select(*node(ident(F.col("e")), F.col("content"), source, "document", F.col("e"), F.col("near")))


def read_triple_questions(spark: SparkSession, path: str, source: str = "metaqa", hop: int = 1, split: str = "train") -> DataFrame:
    """Lines ``question<TAB>answer|answer`` whose golds are the answers' entities; ids are hashes of
    the line, so they don't depend on the order in which files are read."""
    q = attach(spark).read.text(path).select(F.split("value", "\t").alias("p"), F.md5("value").alias("h")).where(F.size("p") == 2)
    gold = F.transform(F.array_distinct(F.split(F.col("p")[1], r"\|")), lambda a: F.concat(F.lit(f"{source}_ent_"), a))
    return q.select(*node(F.concat(F.lit(f"{source}_q_"), "h"), F.col("p")[0], source, "question", None, gold, F.lit(hop), None, F.lit(split)))


def read_subgraphs(spark: SparkSession, path: str, source: str = "webqsp", most: int = 12, degree_cap: int | None = None, max_questions: int | None = None) -> DataFrame:
    """Parquet ``(id, question, a_entity ARRAY, graph ARRAY<ARRAY>)``: entities with up to ``most``
    verbalised relations in order of their text, undirected neighbours, golds from ``a_entity``.
    ``degree_cap`` keeps the first neighbours of an entity by id, ``max_questions`` the first
    questions by id, with their subgraphs; both are off unless given."""
    raw = attach(spark).read.parquet(path)
    if max_questions is not None:
        raw = raw.join(raw.select("id").distinct().orderBy("id").limit(max_questions), "id", "left_semi")
    t = raw.select(F.explode("graph").alias("g")).where(F.size("g") == 3).select(F.col("g")[0].alias("s"), F.col("g")[1].alias("r"), F.col("g")[2].alias("o")).distinct()
    say = F.concat_ws(" ", "s", relation_label(F.col("r")), "o")
    both = t.select(F.col("s").alias("e"), say.alias("x"), F.col("o").alias("n")).unionByName(t.select(F.col("o").alias("e"), say.alias("x"), F.col("s").alias("n")))
    top = both.select("e", "x").distinct().withColumn("i", F.row_number().over(W.partitionBy("e").orderBy("x"))).where(F.col("i") <= most)
    text = top.groupBy("e").agg(F.concat_ws(". ", F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"])).alias("content"))
    ident = lambda c: F.concat(F.lit(f"{source}_doc_"), F.md5(c))
    links = both.where("e <> n").select("e", ident(F.col("n")).alias("n")).distinct()
    if degree_cap is not None:
        links = links.withColumn("i", F.row_number().over(W.partitionBy("e").orderBy("n"))).where(F.col("i") <= degree_cap)
    near = links.groupBy("e").agg(F.array_sort(F.collect_list("n")).alias("near"))
    docs = text.join(near, "e", "left").select(*node(ident(F.col("e")), F.col("content"), source, "document", F.col("e"), F.col("near")))
    gold = F.transform(F.array_distinct("a_entity"), ident)
    return docs.unionByName(raw.select(*node(F.concat(F.lit(f"{source}_q_"), "id"), F.col("question"), source, "question", None, gold)))


def read_corpus_questions(spark: SparkSession, corpus: str, questions: str, source: str) -> DataFrame:
    """A corpus ``[{title, text}]`` and questions with supporting ``paragraphs [{title, text}]``; golds
    by title and text, else by title."""
    c = attach(spark).read.schema("title string, text string").option("multiLine", True).json(corpus)
    c = c.dropDuplicates(["title", "text"]).withColumn("id", F.concat(F.lit(f"{source}_doc_"), F.md5(F.concat_ws("\n", "title", "text"))))
    q = spark.read.schema("id string, question string, paragraphs array<struct<title:string,text:string>>").option("multiLine", True).json(questions)
    p = q.select("id", F.explode("paragraphs").alias("p")).select(F.col("id").alias("qid"), "p.title", "p.text")
    exact = p.join(c.select("title", "text", F.col("id").alias("a")), ["title", "text"], "left")
    byt = c.groupBy("title").agg(F.min("id").alias("b"))
    g = exact.join(byt, "title", "left").groupBy("qid").agg(F.array_sort(F.array_compact(F.collect_set(F.coalesce("a", "b")))).alias("golds"))
    qs = q.join(g, q["id"] == g["qid"], "left")
    return c.select(*node(F.col("id"), F.col("text"), source, "document", F.col("title"))).unionByName(
        qs.select(*node(F.concat(F.lit(f"{source}_q_"), q["id"]), F.col("question"), source, "question", None, F.col("golds")))
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, rnk, node_id, score)`` of JSON lines whose candidates are ids or
    ``{node_id, score}``; a missing score is the list's length minus the 0-based rank."""
    raw = attach(spark).read.schema("query_id string, candidates array<string>").json(path)
    p = raw.select("query_id", F.size("candidates").alias("n"), F.posexplode("candidates").alias("pos", "c"))
    obj = F.from_json("c", "node_id string, score double")
    is_obj = F.col("c").startswith("{")
    return p.select("query_id", (F.col("pos") + 1).alias("rnk"), F.when(is_obj, obj["node_id"]).otherwise(F.col("c")).alias("node_id"), F.coalesce(F.when(is_obj, obj["score"]), (F.col("n") - F.col("pos")).cast("double")).alias("score"))


def union(*nodes: DataFrame) -> DataFrame:
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out


# --- sinks: every writer commits a whole directory at once ----------------------------------------
def write_nodes(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def write_partitioned(df: DataFrame, path: str, by: str = "source") -> None:
    """One directory a partition, so that routed scans are pruned; a partition that holds much of the
    table is split over several files by the adaptive rebalance."""
    df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)


def write_candidates(ranking: DataFrame, golds: DataFrame, path: str, k: int = 100) -> None:
    """JSON lines of each query's first k ids, in order, and its golds."""
    c = ranking.where(F.col("rnk") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "doc_id"))), lambda x: x["doc_id"]).alias("candidates"))
    g = golds.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("golds"))
    c.join(g, "query_id", "left").write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, key: str, metric: str, value: str, path: str) -> None:
    df.groupBy(key).pivot(metric).agg(F.first(value)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text_files(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(file, id)``: the file name of each document, eight digits of its position by id."""
    from evigraph.operators.partition import dense_rank_of

    r = dense_rank_of(docs.select(F.col(id_col).alias("_k")), "_k")
    return r.select(F.format_string("%08d.txt", F.col("idx")).alias("file"), F.col("_k").alias(id_col))


def export_bundle(docs: DataFrame, edges: DataFrame, questions: DataFrame, path: str) -> DataFrame:
    """Three tables and a manifest with their rows and an order-free fingerprint: the sum of row
    hashes, so it needs no sort and combines map-side."""
    spark = docs.sparkSession
    rows = []
    for name, df in (("documents", docs), ("edges", edges), ("questions", questions)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        s = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first()
        rows.append((name, s["n"], str(s["h"])))
    manifest = spark.createDataFrame(rows, "name string, rows long, fingerprint string")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_corpus(docs: DataFrame, path: str, form: str) -> None:
    """The corpus as other systems read it, JSON lines: ``passages`` as ``{idx, title, text}`` with idx
    the 0-based position by ``doc_id``, ``records`` as ``{id, title, text}``, ``contents`` as ``{id,
    contents}`` with the title before the text."""
    from evigraph.operators.partition import dense_rank_of

    d = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    out = {
        "passages": lambda: dense_rank_of(d, "doc_id").select("idx", "title", "text"),
        "records": lambda: d.select(F.col("doc_id").cast("string").alias("id"), "title", "text"),
        "contents": lambda: d.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("\n", "title", "text").alias("contents")),
    }
    if form not in out:
        raise ValueError(f"no form {form}; there are {sorted(out)}")
    out[form]().write.mode("overwrite").json(path)


def classify_paths(paths: DataFrame) -> DataFrame:
    """``(path, dataset, level, artifact)`` of result paths ``results/<level>/<dataset>_<artifact>``."""
    m = lambda i: F.regexp_extract("path", r"results/(?:L|level_)?([^/]+)/([a-z0-9]+)_(.+?)(?:\.\w+)?$", i)
    return paths.select("path", m(2).alias("dataset"), m(1).alias("level"), m(3).alias("artifact"))
