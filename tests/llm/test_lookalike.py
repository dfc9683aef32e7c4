import unicodedata

import pytest

from evigraph.llm import lookalike as L

BASE = "The café of Zafield opened in 1904."
SAME = [
    BASE.replace("a", "а").replace("e", "е"), BASE.replace("Z", "Ζ"), unicodedata.normalize("NFD", BASE), BASE.replace(" ", " "), BASE.replace("field", "​fi­eld"),
    BASE.replace("1904", "１９０４"), BASE.replace("fi", "ﬁ"), "﻿" + BASE + "  ", BASE.replace("d", "ԁ").replace("i", "і"),
]
OTHER = [BASE.lower(), BASE.replace("é", "e"), BASE.replace("1904", "1904²"), BASE.replace(".", "!"), BASE.replace("o", "0"), BASE.replace(" ", "\n", 1), "Кафе открыто"]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {tuple(r) for r in L.found(df).collect()}


def test_same_looks_meet_and_others_stay_apart(spark):
    n = len(SAME)
    assert found(spark, [BASE, *SAME, *OTHER]) == {(i, j) for i in range(n + 1) for j in range(i + 1, n + 1)}


def test_forms_are_consistent_in_their_script(spark):
    corpus = [BASE, "старое село у реки", "Le café", "сор и раса", "το νερό"] * 3 + ["Fοtel", "ѕtаtiоn", "рeки"]
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: r.form for r in L.canonical(df).collect()}
    assert got[0] == BASE and got[1] == "старое село у реки" and got[15] == "Fotel" and got[16] == "station" and got[17] == "реки"


def test_scores_decide_on_confusable_letters(spark):
    """A stray letter of another script is read as what it passes for; a word of one script isn't."""
    corpus = ["the brown ground grew"] * 20 + ["город гора грот"] * 20 + ["bгоwn gгound", "гора", "г", "r"]
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = [r.form for r in L.canonical(df).orderBy("doc_id").collect()]
    assert got[40] == "brown ground" and got[41] == "гора" and got[42] == "г" and got[43] == "r"
    assert got[20] == "город гора грот"
    weak = L.confusables(spark)
    assert "r" in weak["г"] and "a" in weak["α"] and "I" not in weak.get("l", "") and "l" not in weak["І"]
    # the same letters, another corpus: the other script wins
    latin, cyrillic = ({(a, b): 50 for w in ws for a, b in zip(["^", *map(L.symbol, w)], [*map(L.symbol, w), "$"])} for ws in (["rare", "ear"], ["гаге", "еаг"]))
    assert L.Reader(latin, weak).token("гаrе") == "rare" and L.Reader(cyrillic, weak).token("гаrе") == "гаге"


def test_emoji_joiners_stay(spark):
    assert L.normal("👨‍👩‍👧 a‍b") == "👨‍👩‍👧 ab"


def test_nulls_blanks_copies_and_empty(spark):
    assert found(spark, [None, "", " ​ ", "­", "ab", "ab", "a​b"]) == {(4, 6), (5, 6)}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.found(df).count() == 0 and L.canonical(df).count() == 0
    one = spark.createDataFrame([(1, None, "x"), (2, "", "x")], "doc_id long, text string, form string")
    assert {r.doc_id: r.form for r in L.canonical(one).collect()} == {1: None, 2: ""}


def test_many_copies_become_a_star(spark, monkeypatch):
    monkeypatch.setattr(L, "EXPAND", 3)
    got = found(spark, ["ab"] * 4 + ["a​b"] * 4)
    assert got == {(0, j) for j in range(4, 8)} | {(i, 4) for i in range(4)}
    df = spark.createDataFrame([(i, "ab" if i < 4 else "a​b") for i in range(8)], "doc_id long, text string")
    assert L.found(df, whole=True).count() == 16
    assert {tuple(r) for r in L.classes_of(df).collect()} == {(i, 0, 4) for i in range(8)}


@pytest.mark.parametrize("a,b", [("l", "I"), ("O", "0"), ("rn", "m"), ("ª", "a"), ("½", "1/2"), ("’", "'"), ("–", "-")])
def test_different_looks(spark, a, b):
    assert found(spark, [f"x{a}x", f"x{b}x"]) == set()


def test_the_query_writes_every_pair_of_a_large_group(spark, tmp_path):
    """70 by 70 rows of one look: 4,900 pairs, more than EXPAND."""
    from evigraph.llm import queries

    df = spark.createDataFrame([(i, "ab" if i < 70 else "a\u200bb") for i in range(140)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()}
    assert got == {(i, j) for i in range(70) for j in range(70, 140)}
