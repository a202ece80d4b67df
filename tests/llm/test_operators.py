"""Edge cases, round trips and brute force for the training-data operators."""

import base64
import hashlib
import textwrap
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox.llm import decontaminate, language, licenses, lm_score, media, near_dup, packing, quality, toxicity, warc
from tallyvox.llm.queries import default_tokenizer

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
TEXTS = [None, "", "   \n", "one", "One", "a b c d e f g h i j k l", "A b c d e f g h i j k l", LONG, LONG + " tail", "é ü ñ", "x" * 70_000, "\x00 nul"]
SCHEMA = "doc_id long, text string, score double, predicted int, n_words long, bands string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, "x") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(texts, size, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, empty, size):
    base = [f"v{i}" for i in range(120)]
    texts = list(TEXTS)
    for k in range(40):  # a chain: each differs a little from the one before
        base[3 * k % 120] = f"n{k}"
        texts.append(" ".join(base))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows, size, 80).collect()}
    assert got == brute_components(texts, size, 80)
    assert near_dup.near_duplicates(empty, size).count() == 0
    twice = rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, "one")], rows.schema))
    assert near_dup.near_duplicates(twice, size).count() == len(texts) + 4


def test_near_duplicates_in_crowded_buckets(spark, monkeypatch):
    """Texts that share much but are not alike, and some that are: every link is found, however buckets are dealt."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(int(rng.integers(8, 25)))]
        texts.append(" ".join(common + own))
        if k % 4 == 0:
            texts.append(" ".join([*common[3:], *own]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts, 2, 80)
    for split in (1000, 7):
        monkeypatch.setattr(near_dup, "SPLIT", split)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows, 2, 80).collect()} == want
    assert len({c for _, c in want.values()}) < len(texts)
    pairs = near_dup._pairs_of_groups(spark.createDataFrame([("b", 3, i, 100 + i, i, [0]) for i in range(60)], "bucket string, parts int, doc_id long, n long, root long, sketch array<long>"), 80)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a in range(60) for b in range(a + 1, 60) if (100 + a) * 100 >= (100 + b) * 80}


def test_near_duplicates_of_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    ids, texts = [r["doc_id"] for r in docs], [r["text"] for r in docs]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for size in (2, 5):
        want = {ids[i]: (n, ids[c]) for i, (n, c) in brute_components(texts, size, 80).items()}
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(rows, size, 80).collect()} == want


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination(spark, docs, empty, block):
    items = spark.createDataFrame([(1, "B c d e f g h i j k l"), (2, "one"), (3, None), (4, "..."), (5, "zz yy")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.report(decontaminate.contamination(docs, items, 10, block)).collect()}
    assert got[0] == got[1] == (0, 0, 0, False) and got[3] == got[4] == (1, 1, 1, True) and got[5] == got[6] == (12, 11, 1, True)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("size(runs) > 0").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(decontaminate.contamination(docs, items, 10, block)).collect()}
    assert cut[5] == "a " and cut[0] is None and cut[7] == LONG


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = packing.pack_documents(docs, default_tokenizer(), window=256, with_ids=True).collect()
    parts, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["start"], r["ids"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
    for i, t in enumerate(TEXTS):
        assert [x for _, ids in sorted(parts[i]) for x in ids] == tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack_documents(empty, default_tokenizer()).count() == 0


def test_token_ids_are_the_tokenizers():
    """Words, endings and marks by cache or at once, against the tokenizer on the whole text; twice, as the second answer comes from the cache."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["İ. ß!", "A. é. É! J\u030c. ǰ, H\u0331?", "don't. DON'T! it's, 's.", "x...y. z... ...", "<|endoftext|>. A<|ENDOFTEXT|>b", "ǅ. ŉ! ﬁ? Σς. ΑΣ.", "1.5. 3,000! a1.", "\x00. \x1c a.\x85b.\u00a0c.", "漢字。 가각 हिन्दी.", "ÀÉÎÕÜ. àéîõüÿßæð÷×. ÷", '(a) "b." $$$ 9$ a$.', "a.\u0338 b.\n c,\t d;\r\ne:\v f!\f g?", None, ""]
    alphabet = "aAbBzZ0 9.,;:!?$'\"()#*\n\t<|>éÉßÿñÑİıΣς\u0338\u0301\u030c\u00a0 漢가"
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(2000)]
    texts += [" ".join(f"{chr(c)}. A{chr(c)} b{chr(c)}!" for c in range(a, a + 64)) for a in range(0, 0x3000, 64)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tokenizer, ids = Tokenizer.from_file(path), packing.TokenIds(path, 2, remember=500)
        assert ids.by_words == (name == "word_bpe_49k.json")
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        for _ in range(2):
            assert [x.tolist() for a in range(0, len(texts), 50) for x in ids(texts[a : a + 50])] == want


def test_packing_keeps_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, "c", 7), (2, None, 8)], "doc_id long, text string, length int").repartition(2)
    got = packing.pack_documents(rows, default_tokenizer()).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["doc_tokens"]) for r in got for _ in range(r["start"] == 0)) == [(0, 0, 2), (1, 0, 3), (1, 0, 3), (2, 0, 1)]
    assert sum(r["length"] for r in got) == 9


def test_language_model(docs, empty):
    rows = {r["doc_id"]: r for r in lm_score.scores(docs, unit_bytes=4096).collect()}
    assert len(rows) == len(TEXTS) and rows[0]["n_tokens"] == rows[1]["n_tokens"] == 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0 for i, r in rows.items())
    assert lm_score.scores(empty).count() == 0
    weights = lm_score.learn_weights([(3, 40, 8, 90), (3, -999, 8, 10)])
    assert abs(weights[3].sum() - 1) < 1e-6 and weights[3][0] > 0.8


def test_language_model_against_counts(spark):
    """Counts, base scores and model scores of documents against a plain computation with the learned weights."""
    import math
    from collections import Counter

    words = "the river ran past old stone houses and people walked along it".split()
    rng = np.random.default_rng(2)
    run = lambda: [words[(start + k) % len(words)] for start in [rng.integers(0, 12)] for k in range(rng.integers(1, 30))]
    texts = [None, "", *[" ".join(run()) + (" Rare%d" % i if i % 9 == 0 else "") for i in range(250)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "the river")]
    got = lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), unit_bytes=2000).collect()
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    part = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    train = [tokens(t) for i, t in rows if part(i) != 2]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    assert len(got) == len(rows)
    base = lambda t: sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted((i or -1, part(i) == 2, len(tokens(t)), sum(uni[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # The model: weights from EM on fold 3 against counts without it, scores from all counts.
    grams = lambda ts: Counter(p for t in ts for p in zip(["</s>", *t[:-1]], t, strict=True))
    fit = [tokens(t) for i, t in rows if part(i) not in (2, 3)]
    f1, f2, total = Counter(w for t in fit for w in t), grams(fit), sum(len(t) for t in fit)
    level = lambda c: min(int(math.log2(c)) + 1, lm_score.FREQUENCY_BUCKETS - 1) if c else 0
    q = lambda a, b: round(4 * math.log2(a / b * (v + 1))) if a and b else -999
    met = Counter((level(f1[a]), q(f2[a, b], f1[a]), q(f1[b], total)) for i, t in rows if part(i) == 3 for a, b in zip(["</s>", *tokens(t)[:-1]], tokens(t), strict=True))
    weights = lm_score.learn_weights([(*k, c) for k, c in met.items()])
    bi = grams(train)
    for r in got:
        t = tokens(dict(rows)[r["doc_id"]])
        p = [weights[level(uni[a])] @ np.array([bi[a, b] / max(uni[a], 1), uni[b] / n, 1 / (v + 1)]) for a, b in zip(["</s>", *t[:-1]], t, strict=True)]
        assert abs(r["score"] - np.log10(p).sum()) < 1e-3 * len(t), r


def test_media_round_trip(docs, empty):
    for r in media.read_media(media.media_column(docs)).collect():
        payload = media.padded(TEXTS[r["doc_id"]])
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert "gaps:0" in r["feature"] and r["stamps"][0]["random_access"]
    assert media.read_media(media.media_column(empty)).count() == 0
    damaged = bytearray(media.mux(b"x" * 19200))
    damaged[188 * 2] = 0
    read = media.demux(bytes(damaged))
    assert read.faults == ["a packet is damaged"] and read.damaged == 1 and len(read.payload) < 19200
    whole = media.mux(bytes(range(192)) * 100)
    assert media.crc_mpeg(b"") == 0xFFFFFFFF and media.demux(whole).gaps == 0


def test_media_follows_changed_tables():
    """A later program map moves the elementary stream to another pid; a damaged later table is noticed."""
    first, second = media.mux(b"a" * 192 * 70), bytearray(media.mux(b"b" * 192 * 3))
    body = (0xE000 | 0x0222).to_bytes(2, "big") + b"\xf0\x00" + bytes([media.PRIVATE_DATA]) + (0xE000 | 0x0222).to_bytes(2, "big") + b"\xf0\x00"
    moved = media._table_packet(media.PMT_PID, media._section(2, media.PROGRAM, body))
    for at in range(0, len(second), media.PACKET):
        pid = int.from_bytes(second[at + 1 : at + 3], "big") & 0x1FFF
        if pid == media.PMT_PID:
            second[at : at + media.PACKET] = moved
        elif pid == media.MEDIA_PID:
            second[at + 1 : at + 3] = (second[at + 1] << 8 & 0xE000 | 0x0222).to_bytes(2, "big")
    read = media.demux(first + bytes(second))
    assert read.payload == b"a" * 192 * 70 + b"b" * 192 * 3 and read.gaps == 0
    second[media.PACKET + 20] ^= 1  # in the second stream's map
    read = media.demux(first + bytes(second))
    assert read.payload == b"a" * 192 * 70 and "a program table is damaged" in read.faults


def test_archives(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>é</p>\r\n\r\nx", "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://h/ü {i}\r\n", h, "x") for i, h in enumerate(html)] + [(None, "u", "h", "x")], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages, with_payload=True).collect()}
    assert sorted(got, key=str) == [0, 1, 2, 3, 4, 5, None]
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last == i else "revisit", None if last == i else last)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
        assert got[i]["payload"] == (bytearray(raw) if last == i else None)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_keep_repeated_and_missing_pages(spark, monkeypatch):
    """Each row is a capture, whatever page_id it has; hot payloads and small files change nothing."""
    rows = [(1, "a"), (1, "bb"), (2, "a"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (3, ""), (4, None), (5, "bb"), (5, "d"), (-6, "bb")]
    pages = spark.createDataFrame([(i, f"u{k}", h, "x", 1) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, sha string, size int")

    def brute(least):
        out = []
        for i, h in rows:
            same = [j for j, g in rows if (g or "") == (h or "")]
            top = max(same, key=lambda j: (j is not None, j or 0))
            revisit = len((h or "").encode()) >= least and top != i
            out.append((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
        return sorted(out, key=str)

    for least, share, size in ((0, 1000, 1 << 20), (0, 1, 1), (2, 1, 3000)):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        got = warc.archive_round_trip(pages.repartition(2), least_revisit_bytes=least, file_bytes=size).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(least)


def test_toxicity_sees_through_disguise(spark, docs, empty):
    plain = ["the quiet river ran past old stone houses and people walked along it", "we spoke of weather and bread and the long road home"]
    texts = [f"{plain[i % 2]} {i} my {'idiot' if i % 3 == 0 else 'friend'}" for i in range(120)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(120)])
    rows = spark.createDataFrame([(0, "what an id1ot"), (1, "i d i o t he said"), (2, "idiiiiot!!"), (3, "a friend on the road"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(rows, model).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(empty, model).count() == 0
    assert toxicity.train([], [])["weights"] == {}


def test_quality(spark, docs, empty):
    texts = [("BUY!! NOW!! " * 20 if i % 2 else "a calm sentence about rivers and hills and bread ") .encode() * (1 + i % 3) for i in range(60)]
    model = quality.train(texts, [int(i % 2 == 0) for i in range(60)])
    assert quality.margins(texts, *model)[0] > 1 > -1 > quality.margins(texts, *model)[1]
    rows = quality.score(docs, model)
    assert rows.where("score BETWEEN 0 AND 1").count() == len(TEXTS) and quality.score(empty, model).count() == 0


def test_language(spark, docs, empty):
    pieces = [b"the house and the garden", b"das haus und der garten"] * 30
    net = language.train_net(pieces, ["en", "de"] * 30, steps=150)
    rows = spark.createDataFrame([(0, "the garden"), (1, "das haus und"), (2, None), (3, "123 !!"), (4, ""), (None, "the garden")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(rows, net).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["en", "de", "und", "und", "und", "en"]
    assert language.predict(docs, net).count() == len(TEXTS) and language.predict(empty, net).count() == 0


def test_language_labels_every_position_with_carried_state(monkeypatch):
    """Sums by span against the plain network: over the whole text within one span, else with the bytes around a span; whatever texts share a step."""
    net = language.train_net([b"the house and the garden", b"das haus und der garten"] * 30, ["en", "de"] * 30, steps=60)
    texts = [b"", b"x", "The garden é und 12 das Haus".encode(), b"the garden and das haus und " * 200, b"und"]

    def states(side, raw):
        at, mask = language.layout([raw])
        return net._run(side, at, mask)[0][:, 0]

    def brute(raw, span, context):
        raw, total = raw.lower(), np.zeros(2)
        for a in range(0, len(raw), span):
            b = min(a + span, len(raw))
            start = max(0, a - context)
            both = np.concatenate([states("f", raw[start:b])[a - start :], states("b", raw[a : b + context])[: b - a]], axis=1)
            z = both @ net.p["v"] + net.p["o"]
            total += (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).sum(axis=0)
        return total

    for span, context in ((language.SPAN, language.CONTEXT), (7, 3), (1 << 20, 0)):
        monkeypatch.setattr(language, "SPAN", span)
        monkeypatch.setattr(language, "CONTEXT", context)
        together, n = language.Labeller(net)(texts)
        assert n.tolist() == [len(t) for t in texts] and not together[0].any()
        for t, got in zip(texts[1:], together[1:], strict=True):
            assert np.allclose(language.Labeller(net)([t])[0][0], got, rtol=1e-4, atol=1e-2)
            assert np.allclose(brute(t, span, context), got, rtol=1e-3, atol=2e-2)
    at, mask = language.layout([texts[3]])
    assert np.allclose((net.log_probs(at, mask) * mask[..., None]).sum(axis=(0, 1)), together[3], rtol=1e-3)


def test_language_gradients_are_those_of_the_loss():
    net = language.BiGRU(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at, mask = language.layout([b"abca", b"ba", b"c"])
    y = np.array([0, 1, 1])
    found, _ = net.gradients(at, mask, y)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(12):
            i = tuple(rng.integers(0, k) for k in value.shape) if name[0] != "x" else (int(rng.choice([97, 98, 99])), int(rng.integers(0, 9)))
            held, losses = value[i], []
            for step in (1e-2, -1e-2):
                value[i] = held + step
                losses.append(net.gradients(at, mask, y)[1])
            value[i] = held
            assert abs((losses[0] - losses[1]) / 2e-2 - found[name][i]) < 2e-3, (name, i)


def test_language_learns_rare_languages(spark):
    """A language of one in a hundred documents is learned; null and empty rows are not learned from, and no row at all gives `und`."""
    said = {"en": "the house and the garden of the old man", "de": "das haus und der garten von dem mann"}
    rows = [(i, said["de" if i % 100 == 1 else "en"], "de" if i % 100 == 1 else "en") for i in range(600)] + [(None, "x", "en"), (9001, None, "fr"), (9002, "", "fr"), (9003, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, most_docs=20)
    assert net.labels == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.drop("lang"), net).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:600])
    assert language.fit(docs.limit(0)).labels == ["und"]


def test_licences(spark, docs, empty):
    said = "Intro here.\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. All rights reserved."
    rows = spark.createDataFrame([(0, said), (1, None), (2, "Released under the MIT License."), (3, "the licence")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_known"]) for r in licenses.license_scan(rows).collect()}
    assert got == {0: ("ISC,all-rights-reserved", 2), 1: ("", 0), 2: ("MIT", 1), 3: ("", 0)}
    assert all(any(a in s for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())
    assert licenses.license_scan(docs).count() == len(TEXTS) and licenses.license_scan(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: (licence, text, known sentences): each rule's canonical wording.
CANONICAL = [
    ("MIT", MIT, 5), ("BSD-2-Clause", BSD, 3), ("BSD-3-Clause", BSD + ENDORSE, 4), ("ISC", ISC, 2), ("Apache-2.0", APACHE, 5), ("GPL-3.0-or-later", GPL, 3), ("MPL-2.0", MPL, 2),
    ("GPL-3.0-or-later", GPL.split("\n\n")[0], 1), ("ISC", ISC.split("\n\n")[0], 1), ("MPL-2.0", MPL.split(" If")[0], 1), ("Apache-2.0", APACHE.split(" You")[0], 2), ("MIT", MIT.split("\n\n")[2], 1),
    ("BSD-2-Clause", BSD.replace("1. ", "a) ").replace("2. ", "(b) "), 3), ("BSD-3-Clause", (BSD + ENDORSE).replace(". R", ") R").replace("3. ", "* "), 4),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", 1), ("MIT", "Released under the MIT License.", 1), ("MIT", "Licensed under the MIT License.", 1),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", 1), ("CC-BY-4.0", "Licensed under CC BY 4.0.", 1), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", 1),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", 1), ("CC0-1.0", "Licensed under CC0 1.0.", 1), ("all-rights-reserved", "All rights reserved.", 1),
    *((name, f"SPDX-License-Identifier: {said}", 1) for name, said in [("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("MPL-2.0", "MPL-2.0")]),
]


#: (licences, text, known sentences): notices, titles and full grants of further licences.
_LATER = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
FURTHER = [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/", 2), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", 2),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", 2), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999", 2), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", 2),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", 2), ("GPL-2.0-or-later", "This program is free software; " + _LATER.format("General Public License", "2"), 1), ("LGPL-2.1-or-later", "This library is free software; " + _LATER.format("Lesser General Public License", "2.1"), 1),
    ("LGPL-3.0-or-later", "This library is free software: " + _LATER.format("Lesser General Public License", "3"), 1), ("LGPL-3.0-or-later", "This program is free software: " + _LATER.format("Lesser General Public License", "3"), 1),
    ("AGPL-3.0-or-later", "This program is free software: " + _LATER.format("Affero General Public License", "3"), 1), ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", 1),
    ("MPL-2.0", "Mozilla Public License Version 2.0", 1), ("Unlicense", "This is free and unencumbered software released into the public domain.", 1), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", 1),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", 1),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", 3),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", 1), ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", 1), ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", 1),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", 1),
    ("MIT", "Licensed under the MIT license (see LICENSE).", 1), ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details.", 1), ("Apache-2.0", "Distributed under the Apache 2.0 license", 1), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", 1),
    ("GPL-2.0-or-later", "Released under the GNU General Public License version 2 or later", 1), ("LGPL-3.0", "This software is available under LGPL-3.0", 1), ("Unlicense", "Published under the Unlicense", 1), ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", 1),
    ("Apache-2.0,MIT", "SPDX-License-Identifier: MIT OR Apache-2.0", 2), ("Apache-2.0,BSL-1.0,MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSL-1.0", 3), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", 1), ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later", 1),
    *((name.removesuffix("-only"), f"SPDX-License-Identifier: {name}", 1) for name in licenses.SPDX),
    *((name, f"Licensed under the {said}.", 1) for name, names in licenses.NAMES.items() for said in names),
]


@pytest.mark.parametrize(("prefix", "width"), [("", None), (" * ", 70), ("# ", 72)])
def test_further_licences(spark, prefix, width):
    """In plain, wrapped and commented form."""
    wrap = lambda text: "\n".join(prefix + line for part in text.split("\n") for line in (textwrap.wrap(part, width) if width else [part]) or [""])
    texts = [wrap(f"Some words before.\n{text}\n\nand after") for _, text, _ in FURTHER]
    got = licences_of(spark, texts)
    assert {i: (FURTHER[i][1], got[i]) for i in got if got[i] != (FURTHER[i][0], FURTHER[i][2])} == {}
    assert licences_of(spark, ["Not licensed under the MIT license here", "the mit license", "SPDX-License-Identifier: Nobody-1.0 OR MIT"]) == {0: ("", 0), 1: ("", 1), 2: ("MIT", 1)}


def licences_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["licenses"], r["n_known"]) for r in licenses.license_scan(rows).collect()}


def test_licences_in_canonical_wording(spark):
    got = licences_of(spark, [f"Some words before\n{text}\nand after" for _, text, _ in CANONICAL])
    assert got == {i: (name, n) for i, (name, _, n) in enumerate(CANONICAL)}
    assert {name for name, _, _ in CANONICAL + FURTHER} >= {name for name, _ in licenses.RULES} | set(licenses.ALONE)


@pytest.mark.parametrize(("prefix", "width"), [("", 76), (" * ", 70), ("# ", 72), ("// ", 30)])
def test_licences_in_wrapped_lines(spark, prefix, width):
    wrap = lambda text: "\n".join(prefix + line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""])
    got = licences_of(spark, [wrap(f"Some words before\n{text}\nand after") for _, text, _ in CANONICAL])
    assert got == {i: (name, n) for i, (name, _, n) in enumerate(CANONICAL)}
    assert licences_of(spark, ["No stop before\nReleased under the MIT License\nnor after", "All rights\r\nreserved", "not all rights\nreserved"]) == {0: ("MIT", 1), 1: ("all-rights-reserved", 1), 2: ("", 0)}


class Everything(dict):
    def __contains__(self, feature):
        return True


def restorer_of(text):
    return toxicity.Restorer(toxicity.CharModel(toxicity.CharModel.count(set(text.split()))), Everything())


def test_toxicity_restores_doubled_letters_and_edge_signs():
    restored = restorer_of("you are an idiot and a clown what an audio radio said the stupid good folk ass of hit shit")
    for said, meant in [("idioot", "idiot"), ("stuupid", "stupid"), ("(lown", "clown"), ("a$$", "ass"), ("$hit", "shit"), ("aud!o.", "audio"), ("radio+", "radio"), ("idio+", "idiot"), ("(idiot)", "idiot"), ("idiot!", "idiot"), ("good", "good"), ("ass", "ass")]:
        assert meant in restored(said), said
    assert restored("folk") == {"folk"} and restored("...") == set() == restored("")


def test_toxicity_keeps_long_and_spaced_words_whole():
    restored = restorer_of("you are an idiot and a clown what an audio said the stupid one")
    assert "idiot" in restored("idi" + "o" * 60 + "t") and "idiot" in restored("i--" * 1 + "-" * 100 + "d.i.o" + "_" * 100 + "t")
    for said in ("what a i d i o t", "y o u i d i o t", "Y 0 U 1 D 1 O T said", "i d i o t", "y o u a r e a n i d i o t", "s t u p i d i d i o t"):
        assert "idiot" in restored(said), said
    assert {"you", "stupid"} <= restored("y o u s t u p i d o n e")
    began = time.time()
    long = "".join("youareanidiot!"[i % 14] for i in range(200_000))
    assert restored(long) and restored(" ".join(long[:50_000])) and time.time() - began < 60


def slow_decode(token, model):
    """All ways through the lattice."""
    ways = [(0.0, "")]
    for options in toxicity.lattice(token):
        ways = [(cost + price, path + x) for cost, path in ways for x, price in options]
    padded = lambda path: f"^^{path}$"
    return min((round(cost + sum(model(padded(path)[i : i + 3]) for i in range(len(path) + 1)), 6), path) for cost, path in ways)[1]


def test_toxicity_decodes_the_cheapest_path(monkeypatch):
    model = toxicity.CharModel(toxicity.CharModel.count("you are an idiot and a clown what an audio said".split()))
    for flush in (1, 3, 64):
        monkeypatch.setattr(toxicity, "FLUSH", flush)
        for said in ("idi00t", "y0u@re4n1d!ot", "clloo0wn!", "aud1o", "!!", "w|-|at"):
            assert toxicity.decode(said, model) == slow_decode(said, model)


def test_decontamination_blocks_keep_null_and_repeated_ids(spark):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(6)], "item_id long, text string")
    texts = [(None, "x a0 b0 c0 d0 y"), (None, "clean"), (None, "a1 b1 c1 d1 x a2 b2 c2 d2"), (7, "a3 b3 c3 d3"), (7, "a4 b4 c4 d4 a5 b5 c5 d5"), (7, "clean too"), (7, "a3 b3 c3 d3"), (8, None)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = [decontaminate.contamination(rows, items, 3, block) for block in (500_000, 3, 1)]
    one, several, many = (sorted(map(str, f.collect())) for f in found)
    assert one == several == many and len(one) == len(texts)
    assert sorted(str(r["text"]) for r in decontaminate.remove_documents(found[1]).collect()) == ["None", "clean", "clean too"]
    unnamed = items.select(F.when(F.col("item_id") != 0, F.col("item_id")).alias("item_id"), "text")
    for block in (500_000, 1):  # an item without an id is found, but cannot be named
        assert sorted((r["n_hit"], r["n_items"]) for r in decontaminate.report(decontaminate.contamination(rows, unnamed, 3, block)).collect()) == [(0, 0), (0, 0), (0, 0), (4, 0), (4, 1), (4, 1), (8, 2), (8, 2)]


def test_toxicity_filter_loses_no_feature():
    """What is ruled out before decoding would not have been a feature."""
    words = "you are an idiot and a clown what an audio radio said the stupid good folk ass of hit shit letter bottle".split()
    model = toxicity.CharModel(toxicity.CharModel.count(words))
    rng = np.random.default_rng(4)
    weights = dict.fromkeys(["idiot", "clown", "clown~", "stupi~", "ass", "good", "lette~", "shit"], 1.0)
    every, some = toxicity.Restorer(model, Everything()), toxicity.Restorer(model, weights)
    swaps = {"i": "1!", "s": "$5", "o": "0", "a": "@4", "t": "+7", "l": "|1", "e": "3"}
    for _ in range(3000):
        w = "".join(rng.choice(list(swaps[c])) if c in swaps and rng.random() < 0.3 else c * int(rng.integers(1, 4)) if rng.random() < 0.3 else c for c in rng.choice(words))
        w = "".join(rng.choice(list("(.!'\"$*")) for _ in range(rng.integers(0, 3))) + w + "".join(rng.choice(list(").!,$+*")) for _ in range(rng.integers(0, 3)))
        assert set(some(w)) == set(every(w)) & set(weights), w


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a class than the sample once had: all are learned from, and by the same rule as train()."""
    from tallyvox.llm.common import labelled_rows

    words = ["river", "bread", "house", "road", "weather", "stone"]
    said = [f"{words[i % 6]} {words[i % 5]} my {'idiot' if i % 3 == 0 else 'friend'}" + (" zounds" if i in (6390, 6393, 6396, 6399) else "") for i in range(6400)]
    toxic = [int(i % 3 == 0 or i % 97 == 0) for i in range(6400)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = labelled_rows(docs, labels, "toxic", 3, 7)
    assert rows.count() == 6400
    monkeypatch.setattr(toxicity, "HELD", 5)
    got, plain = toxicity.fit(rows), toxicity.train(said, toxic)
    assert got["grams"] == plain["grams"] and "zounds" in got["weights"]
    assert got["weights"].keys() == plain["weights"].keys() and abs(got["bias"] - plain["bias"]) < 1e-3
    assert all(abs(got["weights"][f] - v) < 1e-3 for f, v in plain["weights"].items())
    assert toxicity.fit(rows.where("y = 1"))["weights"] == {} == toxicity.fit(rows.limit(0))["weights"]
