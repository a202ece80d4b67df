"""Labels scored by sentences, chosen by thresholds, in the cases that matter: denial, opposite sides, repeats, overall feeling."""

import pytest
from pyspark.sql import functions as F

from tallyvox.functions.labels import split_fragments
from tallyvox.functions.negation import is_negated, negated, token_array
from tallyvox.functions.wording import fragments
from tallyvox.operators import tagging

PAIR = [("Loud", "detractor", []), ("Quiet", "delighter", [])]
OVERALL = [("Overall Dissatisfaction", "detractor", []), ("Overall Satisfaction", "delighter", [])]
VALUE = [("Good Value", "delighter", []), ("Performs Well", "delighter", [])]
SETUP = [("Difficult Setup", "detractor", []), ("Easy To Use", "delighter", []), ("Easy To Clean", "delighter", [])]
DURABLE = [("Unreliable", "detractor", ["not durable", "breaks"]), ("Good Value", "delighter", []), ("Reliable", "delighter", ["durable"])]
#: (text, stars, catalog, selected, quoted, detractors, delighters)
CASES = [
    ("Heats well, a little noisy. I love the look and how simple it is.", None, PAIR, ["Loud", "Quiet"], [("Loud", "a little noisy"), ("Quiet", "the look")], ["Loud"], []),
    ("Works fine and it is wonderfully quiet, quieter than my last one.", None, PAIR, [], [], [], ["Quiet"]),
    ("I have no issues with noise.", None, PAIR, ["Loud", "Quiet"], [], [], ["Quiet"]),
    ("Sadly not as quiet as hoped.", None, PAIR, ["Quiet"], [], ["Loud"], []),
    ("Our second one, and I love it.", 5.0, OVERALL, [], [], [], ["Overall Satisfaction"]),
    ("Our second one and it’s so good, I love it!", 5.0, OVERALL, [], [], [], ["Overall Satisfaction"]),
    ("Very disappointed, I would not recommend it.", 1.0, OVERALL, [], [], ["Overall Dissatisfaction"], []),
    ("A great value for the price, I love it, and it works great every time.", 5.0, OVERALL + VALUE, ["Overall Satisfaction", "Good Value", "Performs Well"], [], [], ["Good Value", "Performs Well"]),
    ("Good value, but not durable.", None, DURABLE, ["Good Value", "Reliable"], [], ["Unreliable"], ["Good Value"]),
    ("Easy to use once you know it.", None, SETUP, ["Easy To Use", "Easy To Clean"], [], [], ["Easy To Use"]),
    ("The parcel came on a rainy day.", 3.0, PAIR + OVERALL, ["Loud"], [], [], []),
    ("", 5.0, PAIR, ["Loud"], [], [], []),
    (None, None, PAIR, [], [], None, None),
]


def test_negation():
    for phrase, text in [
        ("loud", "not loud"), ("loud", "It is not really loud at all"), ("noise", "no problems with the motor noise"), ("noise", "it was noise-free"), ("quiet", "not as quiet as expected"), ("suction", "could use more suction"),
        ("leaks", "never had any leaks"), ("quiet", "supposed to be quiet but it roars"), ("loud", "only loud at night"), ("cord", "no cord in the box at all"), ("don't fit", "they never don’t fit"),
    ]:
        assert is_negated(phrase, text), (phrase, text)
    assert not any(is_negated(*x) for x in [("loud", "very loud"), ("noise", "the noise is bad, no issues otherwise"), ("loud", "louder"), ("", "x"), ("x", ""), (None, None)])


def test_fragments_are_those_of_the_column(spark):
    texts = ["It works well, but it is loud; heavy too. Short!", "a" * 9 + " even though " + "b" * 9 + "\n\nnext line here", None, "", "no. yes. ok", "On the other hand it shines — brightly • and often"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_fragments("t").alias("f"), negated("loud", token_array(F.col("t"))).alias("n")).orderBy("i").collect()
    assert [r["f"] for r in got] == [fragments(t) for t in texts]
    assert got[0]["f"] == ["It works well", "it is loud", "heavy too."] and not got[2]["n"]


def test_refine(spark):
    quoted = "array<struct<label:string,evidence:string>>"
    for catalog in (PAIR, OVERALL, OVERALL + VALUE, DURABLE, SETUP, PAIR + OVERALL):
        cases = [(str(i), *c) for i, c in enumerate(CASES) if c[2] == catalog]
        rows = spark.createDataFrame([(i, text, stars, q, "extra") for i, text, stars, _, _, q, _, _ in cases], f"review_id string, review_text string, rating double, quoted {quoted}, score string")
        side = {label: s for label, s, _ in catalog}
        selected = spark.createDataFrame([(i, side[s], s) for i, _, _, _, chosen, _, _, _ in cases for s in chosen], "review_id string, side string, label string")
        got = {r["review_id"]: r for r in tagging.refine_tags(tagging.score_tags(rows, catalog), selected, len(catalog)).collect()}
        for i, text, _, _, chosen, _, dets, dels in cases:
            if i not in got:
                assert not dets and not dels, text
                continue
            assert (got[i]["dets"], got[i]["dels"]) == (dets or [], dels or []), text
            assert sorted(got[i]["removed_dets"] + got[i]["removed_dels"]) == sorted(set(chosen) - set((dets or []) + (dels or []))), text


def test_evidence_support(spark):
    rows = [("detractor", "Loud", "so noisy"), ("detractor", "Loud", "not loud"), ("delighter", "Quiet", "the colour"), ("delighter", "Quiet", None), ("delighter", "Quiet", "the colour"), ("detractor", "Missing Parts", "two screws were not included"), ("detractor", "Unknown", "so noisy")]
    tags = spark.createDataFrame(rows, "side string, label string, evidence string")
    got = tagging.supported_evidence(tags, [*PAIR, ("Missing Parts", "detractor", [])]).collect()
    assert sorted((r["label"], r["evidence"] or "", r["supported"]) for r in got) == sorted((x[1], x[2] or "", y) for x, y in zip(rows, [True, True, False, False, False, True, False], strict=True))


def test_refine_keeps_one_of_a_concept_and_at_most_ten(spark):
    scored = spark.createDataFrame(
        [("1", "detractor", f"L{i}", None if i < 12 else "noise", i, 3.0, 1.0, 1, ["x"], 0.0, i < 12, False) for i in range(14)], tagging.SCORED
    )
    got = tagging.refine_tags(scored, spark.createDataFrame([], "review_id string, side string, label string"), 20).collect()[0]
    assert got["dets"] == [f"L{i}" for i in range(10)] and got["dels"] == []
    rest = tagging.refine_tags(scored.where("position >= 12"), spark.createDataFrame([], "review_id string, side string, label string"), 20).collect()[0]
    assert rest["dets"] == ["L12"]


@pytest.mark.parametrize("label", ["Loud", "Easy To Clean", "Overall Satisfaction", "Zebra"])
def test_concepts(label):
    assert tagging.concept_of(label) == {"Loud": "noise", "Easy To Clean": "cleaning", "Overall Satisfaction": "overall"}.get(label)


def test_equal_texts_are_worked_on_once_while_a_task_remembers_them():
    from tallyvox.operators.tagging import Remembered

    seen = []
    known = Remembered(lambda text, stars: seen.append((text, stars)) or [len(text)], most=1000)
    assert [known(t, s) for t, s in (("ab", 1.0), ("ab", 1.0), ("ab", 2.0), ("ab", None), ("ab", None))] == [[2]] * 5
    assert seen == [("ab", 1.0), ("ab", 2.0), ("ab", None)]
    for n in range(100):
        known("x" * n, None)
    assert known.held <= 1000 + 200 + 100 and len(known.known) < 10
