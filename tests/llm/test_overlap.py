import random

import pytest

from evigraph.llm import overlap as O

VIEWS = [(1, "squad", "official train"), (2, "squad", "Dev"), (3, "nq", "held-out TEST"), (4, "x", None), (5, "nq", "train ")]
Q = "Which copper orchard was carried from Gofel Cayehope to Zocel Layiham in 1967?"
ROWS = [
    ("t1", 1, Q, [1, 2]), ("t1", 1, Q, [1, 2]), ("v1", 2, Q.upper() + "  ", [2, 1, -1]), ("v2", 2, "Answer in one line: " + Q.replace("orchard", "orhcard"), [2, 1, 1]),
    ("e1", 3, Q.replace("1967", "1968"), [1, 2]), ("e2", 3, Q, [1, 3]), ("e3", 3, "In which town was the designer of Gofel Cayehope living when Zocel Layiham opened?", [1, 2]),
    ("e4", 4, Q, [1, 2]), ("e5", None, Q, [1, 2]), ("e6", 3, Q, None), ("e7", 3, Q, [-1]), ("e8", 3, None, [1, 2]), ("e9", 3, "?", [1, 2]), (None, 3, Q, [1, 2]),
    ("t2", 5, Q.replace("Which copper orchard was", "which copper orchard had been"), [1, 2]),
]
WANT = {("t1", "v1"), ("t1", "v2"), ("t2", "v1"), ("t2", "v2")}


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(ROWS, "query_id string, view_id int, text string, golds array<long>"), spark.createDataFrame(VIEWS, "view_id int, name string, split string")


def test_pairs(tables):
    assert {tuple(r) for r in O.found(*tables).collect()} == WANT


@pytest.mark.parametrize("block", [1, 2])
def test_blocks_of_any_size_give_the_same(tables, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK", block)
    assert {tuple(r) for r in O.found(*tables).collect()} == WANT


def test_size_of_a_gold_set_changes_no_pair(spark, monkeypatch):
    """Slips in most words and long wrappings leave few words in common, yet count."""
    rng = random.Random(5)
    stems = ["which copper orchard was carried from gofel to zocel", "who sold it", "where did the lantern keeper of bramwick live before the flood", "who sold the ledger of 1967 to wotrin"]
    rows = []
    for i in range(160):
        t = rng.choice(stems)
        words = [w[:1] + w[2:3] + w[1:2] + w[3:] if len(w) > 3 and not w.isdigit() and rng.random() < 0.6 else w for w in t.split()]
        t = " ".join(words)
        t = rng.choice(["{}", "please answer in one line from the passages exactly {} if known", "tell me, so {}?", "{} áö", "{} 7"]).format(t)
        rows.append((f"r{i:03d}", 1 if i % 2 else 2, t, [1]))
    q = spark.createDataFrame(rows, "query_id string, view_id int, text string, golds array<long>")
    v = spark.createDataFrame(VIEWS, "view_id int, name string, split string")
    few = {tuple(r) for r in O.found(q, v).collect()}
    counts = sorted(map(tuple, O.counts(q, v).collect()))
    monkeypatch.setattr(O, "BLOCK", 16)
    monkeypatch.setattr(O, "FEW", 0)
    assert few and {tuple(r) for r in O.found(q, v).collect()} == few
    assert sorted(map(tuple, O.counts(q, v).collect())) == counts


def test_counts(tables):
    got = {(r.split, r.source): (r.queries, r.exact, r.near) for r in O.counts(*tables).collect()}
    assert got[("val", "squad")] == (2, 1, 1) and got[("test", "nq")][1:] == (0, 0)


def test_many_copies_become_a_star_that_loses_no_text(spark, monkeypatch):
    monkeypatch.setattr(O, "EXPAND", 10)
    rows = [(f"t{i:02d}", 1, Q, [1]) for i in range(6)] + [(f"v{i:02d}", 2, Q, [1]) for i in range(6)]
    tables = spark.createDataFrame(rows, "query_id string, view_id int, text string, golds array<long>"), spark.createDataFrame(VIEWS, "view_id int, name string, split string")
    assert O.found(*tables, whole=True).count() == 36
    got = {tuple(r) for r in O.found(*tables).collect()}
    assert got == {("t00", f"v{i:02d}") for i in range(6)} | {(f"t{i:02d}", "v00") for i in range(6)}


def test_all_twins_on_a_large_gold_set(spark):
    """120 training and 120 evaluation questions on one gold set, twins with a slip in every word."""
    rng = random.Random(9)
    def word(n):
        return "".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    rows, want = [], set()
    for i in range(120):
        ws = [word(4) for _ in range(7)]
        rows += [(f"a{i:03d}", 1, " ".join(ws), [1]), (f"b{i:03d}", 2, " ".join(w[:3] + "x" + w[4:] for w in ws), [1])]
        want.add((f"a{i:03d}", f"b{i:03d}"))
    q = spark.createDataFrame(rows, "query_id string, view_id int, text string, golds array<long>")
    v = spark.createDataFrame(VIEWS, "view_id int, name string, split string")
    assert {tuple(r) for r in O.found(q, v).collect()} == want


def test_bounds_lose_no_pair():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(40)]
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if O.ratio(x, y) >= O.SIMILAR}
    assert {(i, j) for i, j, _ in O.near_pairs(texts, texts)} == want
    assert {(i, j) for i, x in enumerate(texts) for _, j, _ in O.near_pairs([x], texts)} == want


def test_classes_hold_all_that_pairs_do(tables):
    members, links = O.classes(*tables)
    of = {r.query_id: (r.class_id, r.links) for r in members.collect()}
    assert of["t1"] == ("t1", 2) and of["v1"][0] == "t1" and of["v1"][1] == 2 and of["e1"][1] == 0
    got = {(r.class_a, r.class_b, r.queries_a, r.queries_b) for r in links.collect()}
    assert got == {("t1", "t1", 1, 1), ("t1", "v2", 1, 1), ("t2", "t1", 1, 1), ("t2", "v2", 1, 1)}
    assert {tuple(r) for r in O.exact(*tables).collect()} == {("t1", "v1")}


def test_empty(tables):
    assert O.found(tables[0].limit(0), tables[1]).count() == 0 and O.counts(tables[0].limit(0), tables[1]).count() == 0 and O.classes(tables[0].limit(0), tables[1])[0].count() == 0
