import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph.sources import formats as S


def nodes(df):
    return {r.node_id: r for r in df.collect()}


def test_squad_chains_paragraphs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "one", "qas": [{"id": "x", "question": "q?", "is_impossible": False, "answers": [{"text": "one"}]}]}, {"context": "two", "qas": []}]}]}))
    n = nodes(S.read_squad(spark, str(tmp_path / "s.json")))
    assert n["squad_doc_0_0"].neighbors == ["squad_doc_0_1"] and n["squad_q_x"].neighbors == ["squad_doc_0_0"]


def test_hotpot_array_and_lines(spark, tmp_path):
    rec = lambda i, t: {"_id": f"q{i}", "question": "?", "context": {"title": ["A", t], "sentences": [["a.", "b."], [f"x{i}"]]}, "supporting_facts": {"title": ["A"]}}
    (tmp_path / "a.json").write_text(json.dumps([rec(1, "B"), rec(2, "B")]))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(rec(i, "B")) for i in (1, 2)))
    one, two = nodes(S.read_hotpot(spark, str(tmp_path / "a.json"))), nodes(S.read_hotpot(spark, str(tmp_path / "l.json")))
    assert one.keys() == two.keys() and len(one) == 4
    b = next(r for r in one.values() if r.metadata.title == "B")
    assert b.content == "x1" and len(one["hotpotqa_q_q1"].neighbors) == 1


def test_paragraphs_dedup(spark, tmp_path):
    p = [{"idx": 0, "title": "A", "paragraph_text": "t", "is_supporting": True}, {"idx": 1, "title": "A", "paragraph_text": "u", "is_supporting": False}]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"id": str(i), "question": "?", "paragraphs": p}) for i in range(2)))
    n = nodes(S.read_paragraphs(spark, str(tmp_path / "m.jsonl")))
    assert len(n) == 4 and len(n["musique_q_0"].neighbors) == 1


def test_triples(spark, tmp_path):
    (tmp_path / "kb.txt").write_text("A|likes_to|B\nC|knows|A\nbad line\nA|likes_to|B\n")
    n = nodes(S.read_triples(spark, str(tmp_path / "kb.txt")))
    assert n["metaqa_ent_A"].content == "A likes to B | C knows A" and n["metaqa_ent_A"].neighbors == ["metaqa_ent_B", "metaqa_ent_C"]
    (tmp_path / "qa.txt").write_text("who?\tB|C\n")
    assert next(iter(nodes(S.read_triple_questions(spark, str(tmp_path / "qa.txt"), hop=2)).values())).metadata.hop == 2


def test_subgraphs_and_candidates(spark, tmp_path):
    pd.DataFrame({"id": ["1"], "question": ["?"], "a_entity": [["A"]], "graph": [[["A", "x.y.born_in", "B"]]]}).to_parquet(tmp_path / "g.parquet")
    n = nodes(S.read_subgraphs(spark, str(tmp_path / "g.parquet")))
    assert {r.content for r in n.values() if r.metadata.type == "document"} == {"A born in B"} and len(n["webqsp_q_1"].neighbors) == 1
    (tmp_path / "c.jsonl").write_text(json.dumps({"query_id": "q", "candidates": ["a", "b"]}))
    assert [(r.node_id, r.score) for r in S.read_candidates(spark, str(tmp_path / "c.jsonl")).orderBy("rnk").collect()] == [("a", 2.0), ("b", 1.0)]


def test_bundle_round_trip_and_fingerprint(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    one = {r.name: (r.rows, r.fingerprint) for r in S.export_bundle(d, d, d, str(tmp_path / "x")).collect()}
    two = {r.name: (r.rows, r.fingerprint) for r in S.export_bundle(d.orderBy("t", ascending=False), d, d.limit(1), str(tmp_path / "y")).collect()}
    assert one["documents"] == two["documents"] and one["questions"] != two["questions"]
    assert [r.file for r in S.text_files(d, "id").orderBy("file").collect()] == ["00000000.txt", "00000001.txt"]


def test_streamed_postings_are_kept_once(spark, tmp_path):
    from evigraph.streaming.events import maintain_postings

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame([(i, "a b a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        maintain_postings(spark, "doc_id long, text string", src, out)
    got = spark.read.parquet(f"{out}/postings")
    assert sorted((r.doc_id, r.term, r.tf) for r in got.collect()) == [(0, "a", 2), (0, "b", 1), (1, "a", 2), (1, "b", 1)]


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_nodes_jsonl_csv_and_sinks(spark, tmp_path):
    rows = [{"node_id": f"n{i}", "content": "c", "metadata": {"source": "s" if i else "t", "hop": i}, "neighbors": ["n0"], "other": 1} for i in range(3)]
    a = S.read_nodes(spark, lines(tmp_path / "l.jsonl", *rows))
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    b = S.read_nodes(spark, str(tmp_path / "a.json"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 3
    for form in ("parquet", "json"):
        S.write_nodes(a, str(tmp_path / form), form)
        assert spark.read.schema(S.NODE).format(form).load(str(tmp_path / form)).count() == 3
    S.write_partitioned(a.select("node_id", F.col("metadata.source").alias("source")), str(tmp_path / "p"))
    assert {x.name for x in (tmp_path / "p").iterdir() if x.is_dir()} == {"source=s", "source=t"}
    assert S.read_jsonl(spark, str(tmp_path / "l.jsonl"), "node_id string, other long").agg(F.sum("other")).first()[0] == 3
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    r = spark.createDataFrame([("q", 1, "d2"), ("q", 2, "d1"), ("q", 3, "d0")], "query_id string, rnk int, doc_id string")
    S.write_candidates(r, spark.createDataFrame([("q", "d1")], "query_id string, doc_id string"), str(tmp_path / "c"), 2)
    assert json.loads(spark.read.text(str(tmp_path / "c")).first()[0]) == {"query_id": "q", "candidates": ["d2", "d1"], "golds": ["d1"]}
    S.write_metrics(spark.createDataFrame([("a", "r", 1.0), ("a", "p", 2.0)], "k string, m string, v double"), "k", "m", "v", str(tmp_path / "m"))
    assert [tuple(x) for x in S.read_csv(spark, str(tmp_path / "m"), "k string, p double, r double").collect()] == [("a", 2.0, 1.0)]
    got = S.classify_paths(spark.createDataFrame([("results/level_2/squad_reranking.json",), ("results/L1/nq_x_y.csv",)], "path string")).collect()
    assert [tuple(x)[1:] for x in got] == [("squad", "2", "reranking"), ("nq", "1", "x_y")]


def test_corpus_for_other_systems(spark, tmp_path):
    d = spark.createDataFrame([(7, "T", "x"), (3, None, "y")], "doc_id long, title string, text string")
    got = {}
    for form in ("passages", "records", "contents"):
        S.write_corpus(d, str(tmp_path / form), form)
        got[form] = sorted((json.loads(r[0]) for r in spark.read.text(str(tmp_path / form)).collect()), key=str)
    assert got["passages"] == [{"idx": 0, "title": "", "text": "y"}, {"idx": 1, "title": "T", "text": "x"}]
    assert got["contents"] == [{"id": "3", "contents": "\ny"}, {"id": "7", "contents": "T\nx"}]
    with pytest.raises(ValueError):
        S.write_corpus(d, str(tmp_path / "z"), "other")


def test_contexts_and_corpus_with_questions(spark, tmp_path):
    n = nodes(S.read_contexts(spark, lines(tmp_path / "c.jsonl", {"_id": "a", "question": "?", "titles": ["T", "U"], "texts": ["t", "u"], "supporting": ["U"]})))
    assert n["2wiki_q_a"].neighbors == ["2wiki_doc_a_1"] and n["2wiki_doc_a_0"].content == "t"
    (tmp_path / "corpus.json").write_text(json.dumps([{"title": "T", "text": "t"}, {"title": "T", "text": "other"}, {"title": "U", "text": "u"}]))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "?", "paragraphs": [{"title": "T", "text": "t"}, {"title": "U", "text": "not as there"}]}]))
    n = nodes(S.read_corpus_questions(spark, str(tmp_path / "corpus.json"), str(tmp_path / "q.json"), "s"))
    assert len(n) == 4 and sorted(n[x].content for x in n["s_q_1"].neighbors) == ["t", "u"]


def test_wrapped_paragraphs(spark, tmp_path):
    rows = [
        {"id": "a", "question": "?", "paragraphs": [{"title": "T", "paragraph_text": "t", "is_supporting": True}, {"paragraph_text": ""}, "bad"]},
        {"id": "b", "question": "?", "metadata": {"paragraphs": [{"content": "p"}]}},
        {"id": "c", "question": "?", "metadata": {"context": {"content": [["x.", "y."], "z"]}}},
        {"id": "d", "question": "?", "metadata": {"question_decomposition": [{"support_paragraph": "{'idx': 1, 'title': 'It\\'s', 'paragraph_text': 'w'}"}, {"support_paragraph": "{broken"}, {}]}},
        {"id": "e", "question": None},
    ]
    n = nodes(S.read_wrapped(spark, lines(tmp_path / "w.jsonl", *rows)))
    assert {k: v.content for k, v in n.items() if "_doc_" in k} == {"musique_doc_a_0": "t", "musique_doc_b_0": "p", "musique_doc_c_0": "x. y.", "musique_doc_c_1": "z", "musique_doc_d_0": "w"}
    assert n["musique_q_a"].neighbors == ["musique_doc_a_0"] and n["musique_doc_a_0"].neighbors == ["musique_q_a"] and n["musique_q_b"].neighbors == []
    assert n["musique_doc_d_0"].metadata.title == "It's" and n["musique_q_d"].neighbors == ["musique_doc_d_0"] and n["musique_q_e"].content == ""


def test_views_are_checked(spark, tmp_path):
    ctx = [["A", ["a.", "b."]], ["B", ["c."]], ["A", ["again"]]]
    pd.DataFrame({"_id": ["1"], "question": ["?"], "context": [json.dumps(ctx)], "supporting_facts": [json.dumps([["A", 0], ["B", 0], ["A", 1]])]}).to_parquet(tmp_path / "v.parquet")
    docs, q = S.read_view(spark, str(tmp_path / "v.parquet"), "titles")
    text = {r.doc_key: r.text for r in docs.collect()}
    assert sorted(text.values()) == ["a. b.", "again", "c."] and {text[k] for k in q.first().golds} == {"again", "c."}
    ps = lambda *own: [{"title": f"t{i}", "paragraph_text": f"x{i}", "is_supporting": o} for i, o in enumerate(own)]
    docs, q = S.read_view(spark, lines(tmp_path / "p.jsonl", {"id": "1", "question": "?", "paragraphs": ps(True, False, True)}), "paragraphs")
    assert docs.count() == 3 and len(q.first().golds) == 2
    with pytest.raises(ValueError, match="1 queries with invalid support"):
        S.read_view(spark, lines(tmp_path / "p.jsonl", {"id": "1", "question": "?", "paragraphs": ps(True, False)}), "paragraphs")
    row = {"id": "1", "question": "?", "context": {"title": ["A", "B"], "sentences": [["a"], ["b"]]}, "supporting_facts": {"title": ["A", "B", "A"]}}
    assert len(S.read_view(spark, lines(tmp_path / "h.jsonl", row), "lists", exact=2)[1].first().golds) == 2
    with pytest.raises(ValueError, match="invalid support"):
        S.read_view(spark, lines(tmp_path / "h.jsonl", {**row, "supporting_facts": {"title": ["A", "Z"]}}), "lists", exact=2)


def test_subgraph_limits(spark, tmp_path):
    pd.DataFrame({"id": ["1", "2"], "question": ["?", "?"], "a_entity": [["A"], ["Z"]], "graph": [[["A", "r", x] for x in "BCD"], [["Z", "r", "Y"]]]}).to_parquet(tmp_path / "g.parquet")
    n = nodes(S.read_subgraphs(spark, str(tmp_path / "g.parquet"), degree_cap=2, max_questions=1))
    assert "webqsp_q_2" not in n and len(n) == 5
    a = n[n["webqsp_q_1"].neighbors[0]]
    assert len(a.neighbors) == 2 and a.metadata.title == "A"


def event(i, ts, kind="a"):
    return (i, ts, 1, kind, 1.0, None)


def feed(spark, path, *rows):
    import datetime as dt

    rows = [(i, dt.datetime.fromisoformat(t), u, k, v, p) for i, t, u, k, v, p in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("mode", ["update", "append"])
def test_stream_goes_on_and_drops_what_is_too_late(spark, tmp_path, mode):
    from evigraph.streaming.events import run_windows

    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go():
        return {r.start[11:13]: r.n for r in run_windows(spark, src, out, late="2 hours", mode=mode).collect()}

    feed(spark, src, event(1, "2024-01-01 10:10:00"), event(2, "2024-01-01 10:20:00"), event(3, "2024-01-01 11:30:00"))
    first = go()
    feed(spark, src, event(4, "2024-01-01 10:50:00"), event(5, "2024-01-01 15:00:00"))  # the first is late, but in time
    second = go()
    feed(spark, src, event(6, "2024-01-01 10:59:00"), event(7, "2024-01-01 15:30:00"), event(8, "2024-01-01 19:00:00"))  # the first is too late
    third = go()
    if mode == "update":
        assert first == {"10": 2, "11": 1} and second == {"10": 3, "11": 1, "15": 1} and third == {"10": 3, "11": 1, "15": 2, "19": 1}
    else:
        assert first == {} and third == {"10": 3, "11": 1, "15": 2}
