"""What a user plugs in, and provenance over edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph import interfaces as I
from evigraph.functions import text as T
from evigraph.operators import fusion, provenance


def test_encoder_is_deterministic_and_of_length_one(spark):
    e = I.HashedEncoder(16)
    v = e.encode(["The old mill", "mill old THE!", "", "x"])
    assert np.allclose(v[0], v[1]) and not v[2].any() and np.allclose((v * v).sum(axis=1), [1, 1, 0, 1])
    df = spark.createDataFrame([(1, "The old mill", "clash"), (2, None, "clash"), (None, "x", "clash")], "doc_id long, text string, vec string")
    got = {r.doc_id: r.vec for r in I.encode(df, "doc_id", "text", e).collect()}
    assert got.keys() == {1, 2} and np.allclose(got[1], v[0])


def test_models_and_retrievers(spark):
    df = spark.createDataFrame([(1, "Context:\n[1] T\none two three\n\nQuestion: q"), (2, None)], "id long, p string")
    assert [tuple(r) for r in I.generate(df, "id", "p", I.ExtractiveModel(2)).collect()] == [(1, "one two")]
    assert I.generate(df, "id", "p", I.ConstantModel("no")).first().answer == "no"
    docs = spark.createDataFrame([(1, "the copper lantern"), (2, "an old bridge"), (3, "copper")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "old bridge")], "query_id long, text string")
    for name in ("hashed", "bm25"):
        assert I.retrieve(name, q, docs, 1).first().doc_id == 2
    with pytest.raises(KeyError):
        I.retrieve("other", q, docs, 1)
    with pytest.raises(ValueError):
        I.retriever("bm25")(lambda *a: None)


def test_ids_of_mixed_shapes(spark):
    rows = [
        '{"retrieved_docs": {"document": [{"id": "d1"}, {"document_id": "d2"}, {"title": "d3"}]}}', '{"doc_ids": ["b", "a", "b", null]}', '{"document_ids": "x"}',
        '{"retrieved_docs": {"document": [], "passages": ["p"]}}', '{"other": 1}', '{"retrieved_document_ids": [], "doc_ids": ["z"]}', '{"retrieved_doc_ids": [{"id": "", "name": "n"}, 7]}',
    ]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(T.retrieved_ids(F.col("x"))).collect()]
    assert got == [["d1", "d2", "d3"], ["b", "a"], ["x"], ["p"], [], [], ["n", "7"]]
    meta = '{"answer": "b", "gold_answers": [{"text": "a"}, {"answer": "c"}, "b", ""], "gold_answer": {"text": "d"}}'
    assert spark.createDataFrame([(meta,)], "x string").select(T.metadata_answers(F.col("x"))).first()[0] == ["a", "b", "c", "d"]


def test_csv_section(spark):
    blob = '\n-----Sources-----\n```csv\n"id","content"\n0,"first line\nsecond line"\n1,"another source"\n2,\n```\n'
    df = spark.createDataFrame([(1, blob), (2, "no section"), (3, None)], "i long, b string")
    assert [tuple(r) for r in T.csv_section(df, "i", "b").orderBy("pos").collect()] == [(1, 1, "first line\nsecond line"), (1, 2, "another source")]


def test_projections(spark):
    c = spark.createDataFrame([("q", i, x) for i, x in enumerate(["c1", "c2", "c3", "c4"])], "query_id string, pos int, chunk string")
    m = spark.createDataFrame([("c1", "d2"), ("c2", "d1"), ("c3", "d2"), ("c4", "d3")], "chunk string, doc string")
    assert [tuple(r) for r in fusion.project(c, m, 2).orderBy("rnk").collect()] == [("q", "d2", 1), ("q", "d1", 2)]
    with pytest.raises(KeyError):
        fusion.project(c, m.where("chunk <> 'c4'"), 2, strict=True)
    # two nodes, the first over documents 1 and 2, the second over 2; the dense ranking is 3, 1, 2
    nodes = spark.createDataFrame([("q", 20, 1), ("q", 21, 2)], "query_id string, node int, rnk int")
    under = spark.createDataFrame([(20, 1), (20, 2), (21, 2)], "node int, doc_id int")
    dense = spark.createDataFrame([("q", 3, 1), ("q", 1, 2), ("q", 2, 3)], "query_id string, doc_id int, rnk int")
    assert [r.doc_id for r in fusion.tree_and_dense(nodes, under, dense, 3).orderBy("rnk").collect()] == [2, 1, 3]


def test_provenance_of_shared_nodes_and_cycles(spark):
    e = spark.createDataFrame([(0, 2), (1, 2), (1, 3), (2, 4), (3, 4)], "child long, parent long")
    got = {(r.child, r.parent): r.hop for r in provenance.ancestors(e).collect()}
    assert got == {(0, 2): 1, (1, 2): 1, (1, 3): 1, (2, 4): 1, (3, 4): 1, (0, 4): 2, (1, 4): 2}
    assert provenance.ancestors(e.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        provenance.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")).count()
    docs = {}
    for (leaf, node) in ((c, p) for c, p in got if c in (0, 1)):
        docs.setdefault(node, set()).add({0: "d1", 1: "d2"}[leaf])
    assert docs == {2: {"d1", "d2"}, 3: {"d2"}, 4: {"d1", "d2"}}


def test_weights_by_coordinate_ascent(spark):
    a = spark.createDataFrame([(q, d, r) for q in (1, 2) for r, d in enumerate([5, 6, 7], 1)], "query_id long, doc_id long, rnk long")
    b = spark.createDataFrame([(q, d, r) for q in (1, 2) for r, d in enumerate([7, 8, 9], 1)], "query_id long, doc_id long, rnk long")
    g = spark.createDataFrame([(1, 8), (2, 8)], "query_id long, doc_id long")
    w = fusion.ascend({"a": a, "b": b}, g, (0.0, 1.0, 2.0), 2, 2)
    assert w["a"] == 0.0 and w["b"] == 1.0
