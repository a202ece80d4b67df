"""Each stage of the corpus pipeline, and all of them, against a plain Python version on a small fixture."""

import zlib

import numpy as np
import pytest
from test_operators import brute_components

import corpus_pipeline
from tallyvox.llm import quality, toxicity
from tallyvox.llm.queries import default_tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"
POOR = "BUY!! NOW!! cheap cheap cheap deals "


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = "river stone house bread garden morning letter window summer village market harbour winter teacher music forest paper silver road candle".split()
    calm = lambda n: " ".join(rng.choice(words, n))
    passage = "the quick brown fox jumps over the lazy dog near the old mill today"
    docs, labels = [], []
    for i in range(240):
        kind = i % 6
        text = calm(60) + "."
        if kind == 1:
            text = f"{calm(25)} you are an idi0t and a m0ron {calm(25)}"
        elif kind == 2:
            text = POOR * 8 + calm(5)
        elif kind == 3 and i > 6:
            text = docs[i - 3][1] + (" extra" if i % 4 else "")
        elif kind == 4:
            text = f"{calm(30)} {passage} {calm(20)}"
        docs.append((i, text, "en", "s", len(text), 0.1))
        labels.append((i, int(kind != 2), int(kind == 1)))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s", 0, None), (None, calm(40), "en", "s", 1, None), (902, " \n ", "en", "s", 3, None), (0, docs[0][1], "en", "s", 1, None)]
    benchmark = [(1, passage), (2, None), (3, "")]
    return docs, labels, benchmark


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, benchmark = corpus
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def sample(docs, labels, at, modulus, held):
    known = {x[0]: x[at] for x in labels if zlib.crc32(str(x[0]).encode()) % modulus != held}
    return sorted(((d[0], d[1], known[d[0]]) for d in docs if d[0] in known), key=lambda r: (r[0], r[2]))


def plain_toxicity(docs, labels):
    rows = sample(docs, labels, 2, 3, 1)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    restorer = toxicity.Restorer(toxicity.CharModel(model["grams"]), model["weights"])
    return [d for d in docs if 1 / (1 + np.exp(-(model["bias"] + sum(model["weights"][f] for f in restorer(d[1]))))) < 0.7]


def plain_quality(docs, labels):
    rows = sample(docs, labels, 1, 4, 2)
    model = quality.train([(t or "").encode() for _, t, _ in rows], [y for _, _, y in rows])
    return [d for d in docs if 1 / (1 + np.exp(-quality.margins([(d[1] or "").encode()], *model)[0])) >= 0.7]


def plain_near(docs):
    named = [d for d in docs if d[0] is not None]
    ids = sorted({d[0] for d in named})
    roots = brute_components([next(d[1] for d in named if d[0] == i) for i in ids], 5, 80)
    kept = {ids[i] for i, (_, root) in roots.items() if root == i}
    return [d for d in docs if d[0] is None or d[0] in kept]


def plain_clean(docs, benchmark):
    import re

    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    windows = {tuple(w[k : k + 10]) for _, t in benchmark for w in [words(t)] for k in range(max(1, len(w) - 9)) if w}
    return [d for d in docs if not any(tuple(w[k : k + 10]) in windows for w in [words(d[1])] for k in range(len(w)))]


def pieces(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return sorted((d[0] or -1, len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) + 1) for d in docs)


def test_stages_and_run(spark, corpus, folder):
    docs, labels, benchmark = corpus
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    state = docs
    plain = {"toxicity": lambda x: plain_toxicity(x, labels), "quality": lambda x: plain_quality(x, labels), "near_duplicates": plain_near, "decontamination": lambda x: plain_clean(x, benchmark)}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*plain, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state, plain[name](state)
        rows = stage(spark, rows, folder)
        assert rows.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        got = rows.collect()
        found, want = [sorted(str((i, t)) for i, t in x) for x in (((r["doc_id"], r["text"]) for r in got), ((d[0], d[1]) for d in state))]
        assert found == want, (name, [x[:20] for x in set(found) ^ set(want)], len(found), len(want))
        assert len(state) < len(before), name
        rows = spark.createDataFrame(got, COLUMNS).repartition(2)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in packed if r["start"] == 0) == pieces(state)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in whole if r["start"] == 0) == pieces(state)
    assert {d[0] for d in state} >= {0, 6} and not {d[0] for d in state} & {1, 2, 4}


def test_empty_tables(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, rows, str(tmp_path)).count() == rows.count() == corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).count()
    assert corpus_pipeline.keep_quality(spark, rows, str(tmp_path)).count() == rows.count()
