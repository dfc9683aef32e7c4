"""Problem 5: same or nearly the same queries across splits.

Canonical texts and gold sets are hashed on the JVM. Queries that agree in both are one class, told
by a 128-bit and an independent 64-bit hash, so that copies cost one row; a class with queries on
both sides is an exact overlap. Different classes of one gold set are compared in blocks of bounded
size, whatever the gold set's own size, by bounds that follow from the score itself, so that no
similar pair is missed. Candidates are scored on their canonical texts.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.canonical import words
from evigraph.session import attach, cut

SIMILAR = 0.75  # ratio of matching characters from which two canonical questions are nearly the same
BLOCK = 256  # classes of a side in a block
FEW = 64  # pairs of two blocks up to which counting characters first doesn't pay; changes no result
EXPAND = 4_096  # pairs of copies of two classes that found() writes out; larger products as a star

#: Wrappings that ask for nothing else.
WRAPPINGS = [
    "answer in one line", "from the passages", "please answer", "tell me", "one answer", "if known",
    "exactly", "question", "please", "so", "q",
]


def split_of(name: Column) -> Column:
    """``train``, ``val`` or ``test`` from a view's own wording of its split, else null."""
    s = F.lower(name)
    return (
        F.when(s.rlike(r"\btrain(ing)?\b"), "train")
        .when(s.rlike(r"\btest\b"), "test")
        .when(s.rlike(r"\b(val|valid|validation|dev|development)\b"), "val")
    )


def gold_set(golds: Column) -> Column:
    """Sorted distinct golds without padding; null if there are none."""
    own = F.array_sort(F.array_distinct(F.filter(golds, lambda g: g.isNotNull() & (g != -1))))
    return F.when(F.size(own) > 0, own)


def unwrapped(text: str) -> str:
    """Canonical text without accents and wrappings."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    padded = f" {text} "
    for w in WRAPPINGS:
        padded = padded.replace(f" {w} ", "  ").replace("  ", " ")
    return padded.strip() or text


def numbers(text: str) -> list[str]:
    return sorted(w for w in text.split() if w.isdigit())


def ratio(x: str, y: str) -> float:
    """Share of matching characters of two unwrapped texts, in the order of the texts, so that
    swapped words count as differences; 0 if the numbers differ."""
    x, y = sorted((x, y))
    if x == y:
        return 1.0
    if numbers(x) != numbers(y):
        return 0.0
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def common_subsequence(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of ``b`` and a text of ``n`` characters, of whose
    characters ``places`` has the positions as bits."""
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _bags(texts: list[str], known: dict[str, int]) -> np.ndarray:
    bags = np.zeros((len(texts), len(known)), np.int32)
    for j, t in enumerate(texts):
        for c in t:
            if c in known:
                bags[j, known[c]] += 1
    return bags


def near_pairs(x: list[str], y: list[str]) -> list[tuple[int, int, float]]:
    """``(i, j, ratio)`` of all pairs of two lists of unwrapped texts with a ratio of SIMILAR at
    least.

    Matching characters are a common subsequence, so neither the shorter text nor the common
    characters nor the longest common subsequence is smaller: what these bounds drop has a ratio
    under SIMILAR."""
    sizes = np.array([len(t) for t in y], np.int64)
    many = len(x) * len(y) > FEW
    if many:
        known = {c: k for k, c in enumerate(sorted(set("".join(y))))}
        left, right = _bags(x, known), _bags(y, known)
    out = []
    for i, t in enumerate(x):
        least = SIMILAR * (len(t) + sizes)
        js = np.flatnonzero(2 * np.minimum(len(t), sizes) >= least)
        if many:
            js = js[2 * np.minimum(right[js], left[i]).sum(axis=1) >= least[js]]
        if not len(js):
            continue
        places: dict[str, int] = {}
        for k, c in enumerate(t):
            places[c] = places.get(c, 0) | 1 << k
        for j in js.tolist():
            if 2 * common_subsequence(places, len(t), y[j]) >= least[j]:
                s = ratio(t, y[j])
                if s >= SIMILAR:
                    out.append((i, j, s))
    return out


def _unwrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [unwrapped(t) for t in batch.column(4).to_pylist()]
        key = [" ".join(numbers(t)) for t in plain]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(plain, pa.string()), pa.array(key, pa.string())],
            names=["gold", "cls", "t", "e", "text", "numbers"],
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block against block: one row holds a block of training and one of evaluation classes."""
    for batch in batches:
        a, b, s = [], [], []
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i, j, r in near_pairs([c["text"] for c in left], [c["text"] for c in right]):
                if left[i]["cls"] != right[j]["cls"]:
                    a.append(left[i]["cls"]), b.append(right[j]["cls"]), s.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def _near(classes: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of the near classes of each gold set. Texts whose numbers differ have
    ratio 0, so the numbers belong to the key; each side of a key is dealt into blocks of about
    BLOCK classes by their hash, as many as its counted size asks for."""
    key = ["gold", "numbers"]
    sides = classes.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("mt"), F.max("e").alias("me")).where("n > 1 and mt > 0 and me > 0")
    mixed = classes.join(sides.select("gold"), "gold").select("gold", "cls", "t", "e", "form")
    rows = cut(mixed.mapInArrow(_unwrap, "gold binary, cls binary, t long, e long, text string, numbers string"))
    n = rows.groupBy(*key).agg(F.count_if(F.col("t") > 0).alias("nt"), F.count_if(F.col("e") > 0).alias("ne"), F.count(F.lit(1)).alias("n"))
    sized = rows.join(n.where("n > 1 and nt > 0 and ne > 0").drop("n"), key)

    def side(own: str) -> DataFrame:
        parts = F.ceil(F.col(f"n{own}") / BLOCK)
        of = sized.where(F.col(own) > 0).withColumn("block", F.pmod(F.xxhash64("cls"), parts))
        # a group holds about BLOCK classes, for their number was counted
        return of.groupBy(*key, "block").agg(F.collect_list(F.struct("cls", "text")).alias(f"own_{own}")).drop("block")

    blocks = side("t").join(side("e"), key).select("own_t", "own_e")
    return blocks.mapInArrow(_compare, "a binary, b binary, similarity double")


def twins(queries: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: each query of a view with a split and its class, and the links
    ``(a, b, similarity)`` between classes of training and of evaluation views. A class linked to
    itself, with similarity 1, has the same canonical text on both sides.

    Left out are queries without id, view or split, with a null or empty gold set, and with a text
    without a word. Redelivered rows count once.
    """
    attach(queries.sparkSession)
    v = views.select("view_id", F.col("name").alias("source"), split_of(F.col("split")).alias("split")).where("split is not null")
    q = queries.select("query_id", "view_id", "text", gold_set(F.col("golds")).alias("g")).where("query_id is not null and g is not null")
    q = q.withColumn("form", words(F.col("text"))).where(F.length("form") > 0)
    q = q.join(v, "view_id").select(
        "query_id", "source", "split", "form", (F.col("split") == "train").alias("train"), F.concat_ws(",", "g").alias("g"),
    )
    # two independent hashes: 192 bits tell a class
    both = F.concat(F.unhex(F.md5(F.concat_ws("\u0001", "g", "form"))), F.unhex(F.lpad(F.hex(F.xxhash64("g", "form")), 16, "0")))
    q = q.withColumn("cls", both).withColumn("gold", F.unhex(F.md5("g"))).drop("g")
    # written once: what follows uses them many times, and a plan that repeats them would be huge
    members = cut(q.dropDuplicates(["query_id"]))
    classes = members.groupBy("cls").agg(
        F.first("gold").alias("gold"), F.first("form").alias("form"),
        F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"),
    )
    exact = classes.where("t > 0 and e > 0").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"))
    return members.select("query_id", "source", "split", "train", "cls"), cut(exact.unionByName(_near(classes)))


def pairs(members: DataFrame, links: DataFrame, expand: int | None = None) -> DataFrame:
    """``(query_id_a, query_id_b)`` of linked classes, the smaller id in byte order first. Without
    ``expand`` every pair of copies is written; with it, two classes with more pairs of copies than
    that have each copy paired with the other class's smallest id."""
    t = members.where("train").select(F.col("cls").alias("a"), F.col("query_id").alias("qa"))
    e = members.where("not train").select(F.col("cls").alias("b"), F.col("query_id").alias("qb"))
    if expand is None:
        out = links.select("a", "b").join(t, "a").join(e, "b").select("qa", "qb")
    else:
        tn = t.groupBy("a").agg(F.count(F.lit(1)).alias("na"), F.min("qa").alias("fa"))
        en = e.groupBy("b").agg(F.count(F.lit(1)).alias("nb"), F.min("qb").alias("fb"))
        sized = links.select("a", "b").join(tn, "a").join(en, "b").withColumn("star", F.col("na") * F.col("nb") > expand)
        full = sized.where("not star").select("a", "b").join(t, "a").join(e, "b").select("qa", "qb")
        star = sized.where("star")
        one = star.select("a", F.col("fb").alias("qb")).join(t, "a").select("qa", "qb")
        two = star.select("b", F.col("fa").alias("qa")).join(e, "b").select("qa", "qb")
        out = full.unionByName(one.unionByName(two).distinct())
    return out.select(F.least("qa", "qb").alias("query_id_a"), F.greatest("qa", "qb").alias("query_id_b"))


def found(queries: DataFrame, views: DataFrame, whole: bool = False) -> DataFrame:
    """:func:`pairs` of a training and an evaluation query. The whole result in a form whose size is
    bounded by the input, whatever the copies, is :func:`classes`; ``whole`` writes out the product
    of any two classes, otherwise those of more than EXPAND pairs become a star."""
    return pairs(*twins(queries, views), None if whole else EXPAND)


def exact(queries: DataFrame, views: DataFrame, expand: int | None = None) -> DataFrame:
    """:func:`pairs` whose canonical texts are equal."""
    members, links = twins(queries, views)
    return pairs(members, links.where("a = b"), expand)


def classes(queries: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` at every size: ``(query_id, class_id, links)``, each query with the
    smallest id of its class and the number of queries of the other side that it is linked to, and
    ``(class_a, class_b, similarity, queries_a, queries_b)``, the linked classes of training and
    evaluation queries with the numbers of those. Copies cost a row each, never a pair."""
    members, links = twins(queries, views)
    sizes = members.groupBy("cls").agg(F.min("query_id").alias("class_id"), F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"))
    named = (
        links.join(sizes.select(F.col("cls").alias("a"), F.col("class_id").alias("class_a"), F.col("t").alias("queries_a")), "a")
        .join(sizes.select(F.col("cls").alias("b"), F.col("class_id").alias("class_b"), F.col("e").alias("queries_b")), "b")
    )
    per_a = named.groupBy(F.col("a").alias("cls")).agg(F.sum("queries_b").alias("links")).withColumn("train", F.lit(True))
    per_b = named.groupBy(F.col("b").alias("cls")).agg(F.sum("queries_a").alias("links")).withColumn("train", F.lit(False))
    own = members.join(sizes.select("cls", "class_id"), "cls").join(per_a.unionByName(per_b), ["cls", "train"], "left")
    return (
        own.select("query_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links")),
        named.select("class_a", "class_b", F.round("similarity", 6).alias("similarity"), "queries_a", "queries_b"),
    )


def counts(queries: DataFrame, views: DataFrame) -> DataFrame:
    """``(split, source, queries, exact, near)`` of the evaluation views: how many queries they
    have, how many recur exactly in a training view (after canonicalisation) and how many almost."""
    members, links = twins(queries, views)
    best = links.groupBy(F.col("b").alias("cls")).agg(F.max((F.col("a") == F.col("b")).cast("int")).alias("same"))
    e = members.where("not train").join(best, "cls", "left")
    return e.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("same") == 1).alias("exact"), F.count_if(F.col("same") == 0).alias("near"),
    )
