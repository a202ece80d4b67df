"""Alignment between tokenizers: against whole-text encoding and plain counting, and the perfect hash on its own."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tallyvox.llm import align
from tallyvox.llm.queries import op13_token_alignment

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b   c", "tab\there \n x", "\n \n  y", "it's we'll THEY'RE 's", "<|endoftext|> <s> </s> <unk> <0x41>",
    "naïve café ﬁ ① Å", "日本語 の テキスト", "emoji 👩‍👩‍👧 ​   　 z", "under▁score", "▁", "x" * 300, "nul \x00 \x1c \x85 end", "a " * 200, "123 4567 89,0.1", "é́ é",
    "  line   sep", "mixed\r\n\r\n  lines \t \t end ", "a▁ b", "word " + "  nbsp", "q" * 65 + " " + "▁" * 70,
]


def plain(texts):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by the definition, a text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = align.byte_values()
    found, counts = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            said_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
            said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(said_a) == b"".join(said_b) == b" " + text.encode():
                at_a, at_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
                cut_a = cut_b = 0
                for end in sorted(set(at_a) & set(at_b)):
                    i, j = at_a.index(end) + 1, at_b.index(end) + 1
                    groups.append((ids_a[cut_a:i], ids_b[cut_b:j]))
                    links.append((ids_a[i - 1], ids_b[j - 1]))
                    cut_a, cut_b = i, j
        found.append((groups, links))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for i, (groups, links) in enumerate(found):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


@pytest.mark.parametrize("block_pairs", [align.BLOCK_PAIRS, 40])
def test_alignment(spark, block_pairs, monkeypatch):
    """Hard texts, rows that repeat, a null id and clashing columns; one block of pairs or many, texts together or alone."""
    texts = [*HARD, " ".join(f"w{i} the of" for i in range(300)), *HARD[8:12]]
    if block_pairs == 40:
        monkeypatch.setattr(align, "CHUNK_TOKENS", 30)
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, groups string").repartition(3)
    got = align.align(rows, A, B, groups=True, links=True, block_pairs=block_pairs)
    want = plain(texts)
    found = got.collect()
    assert sorted(tuple(r)[:8] for r in found) == want
    for r in found:
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
        assert len(r["links"]) == r["n_links"] and sum(x["links"] for x in r["links"]) == r["count_sum"] and sum(x["best"] for x in r["links"]) == r["n_best"]
    assert align.align(rows.limit(0), A, B).count() == 0
    only_null = spark.createDataFrame([(None, None), (None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(r["count_sum"] for r in align.align(only_null, A, B).collect()) == [0, 4, 4]


def test_query_is_the_plain_count(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x[1:] for r, x in zip(rows, plain([r["text"] for r in rows]), strict=True)}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in op13_token_alignment(spark, sf).collect()} == want


def test_cache_generations():
    """Small caches, turned over often, give the ids of whole texts."""
    rng = np.random.default_rng(3)
    pair = align.TokenizerPair(A, B, remember=20)
    for _ in range(30):
        texts = [" ".join(rng.choice([t for t in HARD if t], 4)) for _ in range(5)]
        for text, (a, b) in zip(texts, pair(texts), strict=True):
            whole_a, whole_b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            said_b = b"".join(pair.bytes_b[i] for i in whole_b)
            if said_b == b" " + text.encode():
                assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == (whole_a, whole_b)
            else:
                assert (a, b) == (b"", b"")


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 50_000, dtype=np.uint64))
    shard = (align.mix(keys) % np.uint64(align.SHARDS)).astype(int)
    table = align.PerfectHash([align.build_shard(keys[shard == s]) for s in range(align.SHARDS)])
    assert sorted(table(keys).tolist()) == list(range(len(keys)))
    assert (table.keys[table(keys)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64), keys)
    assert (table(others) == -1).all()
    assert len(table.words) * 64 < 5 * len(keys)
    none = align.PerfectHash([align.build_shard(keys[:0])] * align.SHARDS)
    assert (none(keys[:5]) == -1).all()
