"""Searches over term weights against brute force, and that no pair of query and document is shuffled."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.functions import terms
from evigraph.operators import lexical

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(n)] + [(n, None), (n + 1, " ")]


def okapi(docs, query):
    words = {d: (t or "").split() for d, t in docs}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in ws for ws in words.values()) for w in {w for ws in words.values() for w in ws}}
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: low if x < 0 else x for w, x in raw.items()}
    got = {}
    for d, ws in words.items():
        for w in query.split():
            if w in ws:
                tf = ws.count(w)
                got[d] = got.get(d, 0.0) + idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
    return got


def same(got, want, k):
    """The k best, equal to rounding; ids may change places only where scores agree."""
    best = sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
    assert [r.rnk for r in got] == list(range(1, len(best) + 1))
    for r, (_, s) in zip(got, best):
        assert abs(r.score - s) < 2e-6 and abs(want[r.doc_id] - r.score) < 2e-6


@pytest.mark.parametrize("rows", [7, 32_768])
def test_bm25_is_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(terms, "ROWS", rows)
    docs = corpus(400)
    queries = [(f"q{i}", t) for i, t in docs[:25]] + [("none", "unknown"), ("null", None), ("twice", "w50 w50 w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = lexical.bm25(spark.createDataFrame(queries, "query_id string, text string"), df, 8).orderBy("query_id", "rnk").collect()
    for q, text in queries:
        same([r for r in got if r.query_id == q], okapi(docs, text or ""), 8)


@pytest.mark.parametrize("common", [0, 3, 64])
def test_floors_and_common_terms_change_nothing(monkeypatch, common):
    monkeypatch.setattr(terms, "COMMON", common)
    rng = np.random.default_rng(1)
    w = np.where(rng.random((500, 30)) < np.linspace(0.02, 0.9, 30), rng.random((500, 30)), 0.0)
    row, term = np.nonzero(w)
    docs = terms._Postings(row, term, w[row, term], 500, 30)
    queries = [(i, [{"term": str(t), "w": float(x)} for t, x in zip(rng.choice(30, 12, replace=False), rng.random(12) + 0.01)]) for i in range(70)]
    queries += [(70, [{"term": "3", "w": -1.0}, {"term": "29", "w": 0.0}]), (71, [])]
    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    asked = terms.Asked(pa.table({"query_id": [q for q, _ in queries], "terms": pa.array([t for _, t in queries], kind)}))
    asked.term = np.array([int(t["term"]) for _, ts in queries for t in ts])
    for low in (-np.inf, 0.5, 2.0, 99.0):
        for q, hit, s in docs.scores(asked, 0, len(queries), np.full(len(queries), low)):
            mine = [int(t["term"]) for t in queries[q][1]]
            want = w[:, mine] @ np.array([t["w"] for t in queries[q][1]])
            assert list(hit) == list(np.flatnonzero((w[:, mine] > 0).any(axis=1) & (want > low))) and np.allclose(s, want[hit])


def test_rows_of_one_document_go_together(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "a c"), (3, "d")]
    words = {r.doc_id: (sorted(r.t), r.len) for r in lexical.worded(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert words == {1: (["a", "a", "b", "b"], 2), 2: (["a", "c"], 2), 3: (["d"], 1)}


@pytest.mark.parametrize("held", [1 << 20, 2])
def test_only_texts_of_repeated_ids_are_shuffled(spark, monkeypatch, held):
    """One repeated id made every text be shuffled as words, at each use of the table."""
    monkeypatch.setattr(lexical, "MAX_REPEATED", held, raising=False)  # 2: more are repeated than are held, all rows are grouped
    docs = corpus(80, 9)
    again = [docs[i] for i in (3, 3, 10, 41)] + [(5, None), (6, " "), (80, None)]
    words = lexical.worded(spark.createDataFrame([*docs, *again], "doc_id long, text string").repartition(4).localCheckpoint())
    assert "Aggregate" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange hashpartitioning" not in words._jdf.queryExecution().executedPlan().toString()
    got, want = words.collect(), {}
    for i, t in docs + again:
        row = (t or "").split()
        have = want.get(i, ([], 0))
        want[i] = (have[0] + row, max(have[1], len(row)))
    assert len(got) == len(want) and {r.doc_id: (sorted(r.t), r.len) for r in got} == {i: (sorted(t), n) for i, (t, n) in want.items()}


@pytest.mark.parametrize("own", [True, False])
def test_sparse_search_is_the_join(spark, own, monkeypatch):
    df = spark.createDataFrame(corpus(300, 3), "doc_id long, text string").repartition(5)
    v = lexical.sparse_vectors(df, 6)
    want = {(r.query_id, r.rnk): r.score for r in lexical.sparse_topk(v.where("doc_id % 20 = 0"), v, 7, own).collect()}
    got = {(r.query_id, r.rnk): r.score for r in lexical.sparse_search(df, "doc_id % 20 = 0", 7, own, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    monkeypatch.setattr(lexical, "MAX_VOCABULARY_BYTES", 10)  # too large to be held: joined, with the same result
    assert {(r.query_id, r.rnk) for r in lexical.sparse_search(df, "doc_id % 20 = 0", 7, own, 6).collect()} == want.keys()


def test_filled_lists_are_whole_with_and_without_hits(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)] + [(40, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "query_id long, text string")
    got = {}
    for r in lexical.bm25_filled(q, docs, 30).orderBy("query_id", "rnk").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    odd = [i for i in range(40) if i % 2]
    assert got == {1: odd + [i for i in range(40) if not i % 2][:10], 2: list(range(30)), 3: list(range(30))}


@pytest.mark.parametrize("search", ["bm25", "sparse"])
def test_pairs_of_query_and_document_are_not_joined(spark, search):
    """A search by a join on the term shuffles every pair that shares a word."""
    df = spark.createDataFrame(corpus(60, 5), "doc_id long, text string")
    q = df.where("doc_id < 10").select(F.col("doc_id").alias("query_id"), "text")
    got = {"bm25": lambda: lexical.bm25(q, df, 3), "sparse": lambda: lexical.sparse_search(df, "doc_id < 10", 3)}[search]()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x and "term" in x]
    assert not joins and "MapInArrow" in plan
    assert got.count() > 0
