"""Importance resampling and chat formatting, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyvox.llm import chat, importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, percent, buckets, longest, min_words, seed):
    """Rows of (doc_id, n_words, n_features, weight, score, rank) by the definition."""

    def features(text):
        w = WORD.findall((text or "").encode().lower())
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    source = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for x in source for b in x[2]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for i, n, feats in source:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in feats)
        out.append([i, n, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for place, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = place
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("longest", "buckets", "accuracy"), [(1, 10_000, 10_000), (3, 97, 2), (2, 50, 10)])
def test_resample(spark, longest, buckets, accuracy):
    rng = np.random.default_rng(longest)
    vocabulary = ["the", "The", "é", "x" * 64, "y" * 65, "z" * 3000, "Ünï", *(f"w{i}" for i in range(60))]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(300)]
    rows += [(7, rows[7][1]), (None, "a b c " * 9), (None, "a b c " * 9), (301, None), (302, ""), (303, "-- !!"), (304, "the " * 5000), *((i, "copy " * 25) for i in range(400, 480))]
    target = ["the w1 w2 w3 the", None, "", "copy w5"]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench, 10, buckets, longest, 20, 2024, accuracy)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, 10, buckets, longest, 20, 2024)
    assert importance.resample(docs.limit(0), bench).count() == 0
    few = importance.resample(docs.where("doc_id < 5"), bench.limit(0), min_words=1)
    assert few.count() == 5 and few.where("rank IS NOT NULL").count() == 0
    whole = importance.resample(docs.where("doc_id < 40"), bench, percent=100, min_words=0)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(1, 42))


@pytest.mark.parametrize("accuracy", [1, 2, 1000])
def test_bracket_holds_the_cutoff(spark, accuracy):
    """Many ties and a coarse sketch: what the exact counts accept holds the k-th highest."""
    scores = [0] * 400 + [5] * 300 + list(range(-50, 50))
    rows = spark.createDataFrame([(x,) for x in scores], "score long")
    ranked = sorted(scores, reverse=True)
    for k in (1, 10, 80, 350, 800):
        low, high, above, inside = importance.bracket(rows, len(scores), k, accuracy)
        assert low <= ranked[k - 1] <= high
        assert above == sum(x > high for x in scores) and inside == sum(low <= x <= high for x in scores)


def plain_chat(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learned), sha(learned))
    return out


NASTY = ["### ", "###", "#", " ", "\\", "</turn>", "<", "/turn>", "</turn>\n", "\n", ": ", ":", "assistant", "a", "é", "😀", "### assistant: ", "<\\/turn>", "###\\ ", "###\\\\ ", "$1", "\\1", "\r"]


def test_chat_formatting(spark):
    rng = np.random.default_rng(0)
    said = lambda n: "".join(rng.choice(NASTY, int(rng.integers(0, n))))
    rows = [(c, t, str(rng.choice(["user", "assistant", "system"])) if c % 3 else said(6), said(12)) for c in range(40) for t in range(int(rng.integers(1, 9)))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} ### ") for t in range(700)]  # many parts
    rows += [(51, None, "user", "x"), (51, None, "assistant", None), (51, 3, None, "y"), (51, 3, None, "y"), (51, -9, "assistant", ""), (None, 0, "assistant", "no id"), (None, 1, "user", None), (52, 0, "assistant", "long </turn> " * 20_000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(table)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(formatted).collect()}
    assert got == plain_chat(rows)
    for r in formatted.where("conv_id < 55").collect():  # absolute places, in plain Python
        learned = "".join(r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"])
        for before, after in chat.CONTROLS:
            learned = re.sub(rf"{before}\\(\\*){after}", lambda m, b=before, a=after: b + m[1] + a, learned)
        assert hashlib.sha256(learned.encode()).hexdigest() == got[r["conv_id"]][3]
        assert r["formatted"].count("</turn>") == r["n_turns"] == r["formatted"].count("### ")
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_only_conflicts_are_escaped(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a \\ b ## : c < /turn"), (2, 0, "user", "</turn>"), (3, 0, "user", "###\\ x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(rows).collect()}
    assert got == {1: "### user: a \\ b ## : c < /turn</turn>\n", 2: "### user: <\\/turn></turn>\n", 3: "### user: ###\\\\ x</turn>\n"}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(NASTY), st.lists(st.sampled_from(NASTY), max_size=8).map("".join)), min_size=1, max_size=30))
def test_escape_is_reversible(spark, turns):
    rows = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(turns)], "id int, role string, text string")
    back = rows.select("role", "text", chat.unescape(chat.escape(F.col("text"), chat.CONTROLS), chat.CONTROLS).alias("text2"), chat.unescape(chat.escape(F.col("role"), chat.ROLE_CONTROLS), chat.ROLE_CONTROLS).alias("role2"), chat.escape(F.col("text"), chat.CONTROLS).alias("escaped"))
    for r in back.collect():
        assert (r["role"], r["text"]) == (r["role2"], r["text2"])
        assert "### " not in r["escaped"] and "</turn>" not in r["escaped"]


def test_text_outside_the_grammar_is_null(spark):
    rows = spark.createDataFrame([("### user: a",), ("x### user: a</turn>\n",), ("### user a</turn>\n",), ("### user: a ### b</turn>\n",), ("",)], "s string")
    assert [r[0] for r in rows.select(chat.parse("s")).collect()] == [None, [None], [None], [None], []]
