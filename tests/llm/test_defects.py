import numpy as np
import pytest

from evigraph.llm import defects as D

SCHEMA = "id string, question string, prediction string, answers array<string>, contexts array<struct<rank:int,document_id:string,title:string,text:string>>, labels string"
WHERE = "Where is Fotel Sugecot located?"
GOOD = ["It is located in Dovik.", "Dovik", "in Dovik", "Fotel Sugecot stands in Dovik, on the north bank of the river.", "The passages disagree; the better answer is Dovik.", "Sorry for the long wait: Dovik."]
BAD = [
    (None, "empty"), ("", "empty"), (" ​", "empty"), ("[]", "empty"), ("Answer:", "empty"),
    (WHERE, "copies_question"), ("Question: Where is Fotel Sugecot located\nAnswer:", "copies_question"), ("where is fotel sugecot located...", "copies_question"),
    ("I cannot answer this question from the passages.", "refusal"), ("Sorry, the 9 contexts above leave the question open.", "refusal"), ("I'm sorry, but I can't help with that.", "refusal"),
    ("Das Gebäude steht in Dovik, am nördlichen Ufer.", "other_language"), ("se encuentra en Dovik, junto al río", "other_language"), ("Здание находится в городе Dovik.", "other_language"),
    ("It is located in Dovik. The copper ledger beside the", "truncated"), ("It is located in", "truncated"), ("1. Aldo Linbury\n2. Orla Wil\n3.", "truncated"), ("It stands in Dovik. (compare the", "truncated"),
]


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(40):
        for i, p in enumerate(GOOD):
            out.append((f"g{k}_{i}", WHERE, p, ["Dovik"], [(1, "d", "t", "Fotel Sugecot is in Dovik. The copper ledger beside the lantern came from Dovik.")], "clash"))
    for k in range(3):
        for i, (p, _) in enumerate(BAD):
            out.append((f"b{k}_{i}", WHERE, p, ["Dovik"] if k else None, [] if k else None, "clash"))
    out += [("q1", "Wo liegt Fotel Sugecot?", "in Dovik, am Fluss", None, [], "clash"), ("q2", "Which French motto is carved on Fotel Sugecot?", "Le temps passe, la pierre reste", None, [], "clash"), ("q3", None, "Dovik", None, None, "clash"), (None, WHERE, "", None, None, "clash")]
    for k in range(30):
        out.append((f"s{k}", WHERE, "It stands in Dovik. The copper ledger beside the lantern was sold. It is located in Dovik.", ["Dovik"], [], "clash"))
    return out + out[:10]


def test_defects_of_each_kind(spark, rows):
    got = {r.id: r.defect for r in D.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {f"b{k}_{i}": d for k in range(3) for i, (_, d) in enumerate(BAD)}
    missed = {i: (want[i], got.get(i)) for i in want if got.get(i) != want[i]}
    wrong = {i: d for i, d in got.items() if i not in want}
    assert len(missed) <= 0.1 * len(want), missed
    assert not wrong, wrong


@pytest.mark.parametrize("copies", [3, 150])
def test_a_truncated_prediction_counts_however_many_rows_share_it(spark, copies):
    """Cut after a lower-case word that may end a phrase: only the corpus says that it goes on.
    Others with more signs show the label model what that vote is worth."""
    towns = [a + b for a in ("Dov", "Fot", "Zoc", "Gof", "Wot") for b in ("ik", "el", "rin", "am", "uso", "ora")]
    rows = []
    for k in range(300):
        town = towns[k % len(towns)]
        rows.append((f"g{k:03d}", WHERE, f"It stands in {town}. The copper ledger beside the lantern was sold.", [town], [], "clash"))
        if k < 40:
            cut = ("The copper", "The copper ledger", "The copper ledger beside the lantern")[k % 3]
            rows.append((f"c{k:03d}", WHERE, f"It stands in {town}. ({cut}", [town], [], "clash"))
    rows += [(f"t{k:03d}", WHERE, "It stands in Dovik. The copper ledger beside", ["Dovik"], [], "clash") for k in range(copies)]
    got = {r.id: r.defect for r in D.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {f"c{k:03d}": "truncated" for k in range(40)} | {f"t{k:03d}": "truncated" for k in range(copies)}


def test_labels_keep_several_and_each_row_once(spark, rows):
    lab = D.label(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(lab) == len({r[0] for r in rows if r[0]}) and all(0.5 <= x.posterior <= 1 for r in lab for x in r.labels)


def test_empty(spark):
    assert D.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_label_model_recovers_noisy_functions():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    votes = np.stack([np.where(rng.random(len(y)) < a, np.where(y, 1, -1), np.where(rng.random(len(y)) < 0.3, np.where(y, -1, 1), 0)) for a in (0.85, 0.8, 0.75)], axis=1)
    pats, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = D.fit([tuple(p) for p in pats], n.tolist())[inv.ravel()]
    assert ((post > 0.5) == y).mean() > 0.95


def test_cutoffs_bound_false_alarms():
    post, n, good = np.array([0.55, 0.97]), np.array([10.0, 10.0]), np.array([1000.0, 0.0])
    assert D.validated(post, n, good) >= 0.6


def test_all_rows_fit_the_languages_and_validate_the_cutoffs(spark):
    """More rows than were once drawn: each is a known answer and gets a defect put into it."""
    n = 4_600
    rows = [(f"r{k:05d}", WHERE, f"It is located in Dovik{k}.", [f"Dovik{k}"], [], "clash") for k in range(n)]
    got = {r.defect: r for r in D.cutoffs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["empty"].made == n and got["copies_question"].made == n and got["refusal"].made == n


def test_triples_fitted_in_tasks_are_those_of_all_questions(spark):
    questions = [f"Where is the old tower of {w}{k} and who was the owner of it?" for k in range(30) for w in ("Dov", "Fot")] + [f"Wo ist der alte Turm von {k} und wer war das?" for k in range(25)]
    df = spark.createDataFrame([(q,) for q in questions], "question string").repartition(3)
    mine, whole = D.Triples.fitted(df), D.Triples(questions)
    assert mine.logs == whole.logs and set(mine.logs) == {"en", "de"}
    assert all(np.allclose(mine.usual[k], whole.usual[k]) for k in whole.usual)
