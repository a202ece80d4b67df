"""Denied phrases: the cases that matter, and the column function against the one for single texts."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvox.functions import negation as N

DENIED = [
    ("loud", "not loud"), ("loud", "It is not really very loud at all"), ("loud", "never that loud"), ("leaks", "without any leaks"), ("leak", "Without a leak"), ("loud", "isn't loud"), ("loud", "isn’t quite loud"),
    ("noise", "no problems with the motor noise"), ("noise", "No issue regarding noise"), ("noise", "no complaints about the new noise level"), ("noise", "it was noise-free"), ("quiet", "not as quiet as expected"),
    ("suction", "could use more suction"), ("power", "needs more power"), ("noise", "less noise"), ("screws", "Missing screws and loud."), ("charm", "lacking charm"), ("chemicals", "free of chemicals"), ("leaks", "never had any leaks"),
    ("noise", "I never noticed much noise"), ("noise", "zero motor noise"), ("cord", "no cord in the box at all"), ("smell", "no smell to speak of"), ("smell", "no smell whatsoever"), ("quiet", "supposed to be quiet but it roars"),
    ("easy", "advertised to be easy. Unfortunately it is hard"), ("loud", "only loud at night"), ("loud", "just loud when spinning"), ("suction", "would be better with suction"), ("handle", "should have been nicer about the handle"),
    ("don't fit", "they never don’t fit"), ("loud motor", "not a bad thing, not loud motor"), ("hair-dryer", "without a hair dryer"),
]
STANDS = [
    ("loud", "Missing screws and loud."), ("loud", "very loud"), ("noise", "the noise is bad, no issues otherwise"), ("loud", "louder"), ("quiet", "not a quiet machine"), ("loud", "It does not leak. Loud, though"), ("loud", "not good, loud"),
    ("noise", "no issues with leaks, noise is bad"), ("noise", "no noise"), ("loud", "never had one so big and heavy and clumsy and loud"), ("easy", "supposed to be easy"), ("loud", "only a loud one"), ("power", "more power"), ("", "x"), ("x", ""), ("?", "not ?"),
    ("loud", "fewer parts, loud"), ("noise", "zero. noise"), ("suction", "could be better. Suction is fine"),
]


@pytest.mark.parametrize(("cases", "want"), [(DENIED, True), (STANDS, False)])
def test_cases(spark, cases, want):
    for phrase, text in cases:
        assert N.is_negated(phrase, text) is want, (phrase, text)
    rows = spark.createDataFrame(cases, "phrase string, text string").withColumn("words", N.token_array(F.col("text"))).collect()
    assert [list(r["words"]) for r in rows] == [N.tokens(t) for _, t in cases]
    for phrase in {p for p, _ in cases}:
        got = spark.createDataFrame([(t,) for p, t in cases if p == phrase], "text string").select(N.negated(phrase, N.token_array(F.col("text"))).alias("n")).collect()
        assert all(r["n"] is want for r in got), phrase
    assert N.is_negated(None, "not x") is N.is_negated("x", None) is False


def test_column_equals_text(spark):
    """Random sentences of the rules' own words, with nulls and long texts."""
    rng = random.Random(7)
    words = [*N.DENIALS, *N.DEGREES, *N.LACKS, *N.NEEDS, *N.TROUBLES[:3], *N.ABOUT, *N.MET, *N.WISHES, *N.BETTER, *N.CLAIMS[:2], *N.TURNS[:2], *N.ONLY, *N.TIMES, "no", "free", "of", "as", "to", "be", "been", "zero", "any", "a", "all", "whatsoever", "speak", ".", ",", "big"]
    texts = [" ".join(rng.choice(["noise", "big noise"]) if rng.random() < 0.25 else rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + [None, "", "noise", "x " * 3000 + "not noise"]
    for phrase in ("noise", "big noise"):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.negated(phrase, N.token_array(F.col("t"))).alias("n")).collect()
        wrong = [(r["t"], r["n"]) for r in rows if r["n"] is not N.is_negated(phrase, r["t"])]
        assert not wrong, wrong[:3]
        assert 100 < sum(r["n"] for r in rows) < 1400


def test_a_denial_stands_before_any_number_of_degrees(spark):
    far = "not " + "very " * 30 + "loud"
    texts = [far, "not , " + "very " * 30 + "loud", "without " + "really " * 20 + "any " + "very " * 20 + "loud", "not so " + "very " * 20 + "loud", "not . " + "very " * 30 + "loud", "loud, not " + "very " * 13 + "loud", "could have been better " + "so " * 9 + "loud", "could have been better " + "so " * 10 + "loud"]
    expected = [True, False, True, False, False, True, True, False]
    assert [N.is_negated("loud", t) for t in texts] == expected
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.negated("loud", N.token_array(F.col("t"))).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == expected
