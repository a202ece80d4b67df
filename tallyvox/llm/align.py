"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another end, and how often corpus-wide.

Texts are encoded once by both tokenizers; the ids are kept in the shared folder. Each later pass aligns them anew from
the byte lengths of the tokens, with array operations over many texts. The distinct id pairs get a minimal perfect hash:
levels of bits in which each pair that falls alone keeps its place, the rank of its bit being its number; the keys in
that order prove every lookup. Counts are dense vectors indexed by that number, one a task, summed in a tree. Pairs are
dealt to blocks of bounded size by their second id, and only one block's hash is broadcast to a task at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shared_folder, small

#: Distinct pairs of a block, about: at 8 bytes a key, 8 a count and under a byte of bits some 36 MB at most.
BLOCK_PAIRS = 1 << 21
#: Parts in which a block's hash is built, each in a task of its own.
SHARDS = 16
#: Entries of a piece of a count vector, and vectors that one task of the tree adds up.
PIECE, FAN = 1 << 14, 32
#: Bits a key has on each level of the hash.
GAMMA_BITS = 2.0
_LEVELS = 40
#: Tokens of texts aligned together.
CHUNK_TOKENS = 200_000
#: Where a segment may start: a single space before what is not white space.
_ODD, _SEGMENT = re.compile(r"^ | (?:\s|$)"), re.compile(r"(?<=[^ ]) (?=\S)")
#: Characters that both kinds of tokenizer give back as they are.
_SETTLED = re.compile("[\x20-\x7E\xC0-\xFF]+")
#: Segments over this many characters are not cached.
LONG_SEGMENT = 64


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(moved)}


class TokenizerPair:
    """Ids of space + text by a byte-level tokenizer (a), of text by one of sentence pieces (b) that adds the space, and the bytes of each token.

    Where both tokenizers provably end a token before a single space, texts are cut there and the ids of each segment
    are cached in two generations; other tokenizers read whole texts.
    """

    def __init__(self, path_a: str, path_b: str, remember: int = 120_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark keeps the cores busy already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        value = byte_values()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.by_segments = (
            spec["normalizer"] is None
            and {"use_regex": True} | (spec["pre_tokenizer"] or {}) == bytewise
            and all(t["special"] for t in spec["added_tokens"])
            and not any("▁" in p.lstrip("▁") for p in pieces)  # no piece reaches over the start of a word
            and self.b.normalize("  x  ﬁ ①") == "▁▁▁x▁▁ﬁ▁①"  # spaces and characters stay as they are
        )
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in kept], np.int64) for kept in (self.bytes_a, self.bytes_b))
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None}))
        self.remember = remember
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old = self.young
        self.bad: set[str] = set()

    def segments(self, text: str) -> list[str]:
        if not self.by_segments:
            return [text]
        return _SEGMENT.split(text) if _ODD.search(text) else text.split(" ")

    def learn(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of a and of b for each segment, as bytes; what doesn't come back whole goes to bad.

        As many bytes as went in must come back; characters that a tokenizer might write in another way are compared.
        """
        plain = [i for i, w in enumerate(words) if self.by_segments and w.isascii() and w.isalpha()]
        rest = sorted({*range(len(words))}.difference(plain))
        ids_a: list[list[int]] = [[]] * len(words)
        for at, encoder, lead in ((plain, self.bare, "Ġ"), (rest, self.a, " ")):
            for i, x in zip(at, encoder.encode_batch_fast([lead + words[i] for i in at], add_special_tokens=False), strict=True):
                ids_a[i] = x.ids
        ids_b = self.b.encode(words, num_threads=1) if words else []
        raws = [b" " + w.encode() for w in words]
        said = np.fromiter(map(len, raws), np.int64, len(raws))
        out, short = [], np.zeros(len(words), bool)
        for ids, sizes in ((ids_a, self.sizes_a), (ids_b, self.sizes_b)):
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1]) if len(ends) else 0)
            bytes_so_far = np.concatenate([[0], np.cumsum(sizes[flat])])
            short |= np.diff(bytes_so_far[np.concatenate([[0], ends])]) != said
            joined, bounds = flat.tobytes(), (4 * ends).tolist()
            out.append([joined[i:j] for i, j in zip([0, *bounds], bounds)])
        self.bad.update(words[i] for i in np.flatnonzero(short))
        for i in rest:
            if not (self.by_segments and _SETTLED.fullmatch(words[i])) and any(b"".join([kept[k] for k in ids[i]]) != raws[i] for ids, kept in ((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
                self.bad.add(words[i])
        return out[0], out[1]

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids of each text as little-endian unsigned 32-bit numbers; both empty if it has none."""
        if len(self.young[0]) > self.remember:
            self.old, self.young = self.young, ({}, {})
        if len(self.bad) > self.remember:
            self.bad = set()
            self.old = self.young = ({}, {})
        words: list[str] = []
        ends = []
        for t in texts:
            words += self.segments(t) if t else ()
            ends.append(len(words))
        (young_a, young_b), (old_a, old_b) = self.young, self.old
        ids_a = list(map(young_a.get, words))
        missed = [i for i, x in enumerate(ids_a) if x is None]
        fresh = []
        for w in {words[i] for i in missed}:
            if (x := old_a.get(w)) is not None:
                young_a[w], young_b[w] = x, old_b[w]
            else:
                fresh.append(w)
        learnt = dict(zip(fresh, zip(*self.learn(fresh), strict=True), strict=True))
        long = {w: x for w, x in learnt.items() if len(w) > LONG_SEGMENT}  # used once, not kept
        for w, (a, b) in learnt.items():
            if w not in long:
                young_a[w], young_b[w] = a, b
        for i in missed:
            w = words[i]
            ids_a[i] = long[w][0] if w in long else young_a[w]
        ids_b = [young_b[w] if w not in long else long[w][1] for w in words] if long else list(map(young_b.__getitem__, words))
        out = []
        for t, i, j in zip(texts, [0, *ends], ends):
            whole = t and (not self.bad or self.bad.isdisjoint(words[i:j]))
            out.append((b"".join(ids_a[i:j]), b"".join(ids_b[i:j])) if whole else (b"", b""))
        self.bad.difference_update(long)
        return out


_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    if (path_a, path_b) not in _PAIRS:  # a Python worker serves many tasks
        _PAIRS[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def token_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, doc_id, ids_a and ids_b of every row of docs, kept as a table in the shared folder, so that nothing is encoded twice."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(path_a, path_b)
        for batch in small(batches):
            ids = pair(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in zip(*ids, strict=True))], ["doc_id", "ids_a", "ids_b"])

    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    found = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids_a binary, ids_b binary")
    found.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


class Aligned:
    """Some texts' ids of a and b one after the other, and where tokens of both end at one byte."""

    def __init__(self, ids_a: list[bytes], ids_b: list[bytes], bytes_a: np.ndarray, bytes_b: np.ndarray) -> None:
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4") for x in (ids_a, ids_b))
        self.from_a, self.from_b = (np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64) for ids in (ids_a, ids_b))
        # Both say the same bytes, so ends may be counted over all texts together.
        ends_a, ends_b = np.cumsum(bytes_a[self.a]), np.cumsum(bytes_b[self.b])
        at = np.searchsorted(ends_b, ends_a)
        self.last_a = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
        self.last_b = at[self.last_a]
        self.from_link = np.searchsorted(self.last_a, self.from_a)

    def pairs(self) -> np.ndarray:
        """The linked ids, a in the upper half."""
        return (self.a[self.last_a].astype(np.uint64) << np.uint64(32)) | self.b[self.last_b]

    def group_texts(self, digits: np.ndarray, n_digits: np.ndarray) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 of each text."""
        n, m = len(self.a), len(self.b)
        group_a, group_b = np.searchsorted(self.last_a, np.arange(n)), np.searchsorted(self.last_b, np.arange(m))
        first_b, end_a = np.concatenate([[0], self.last_b + 1]), self.last_a + 1
        slot_a, slot_b = np.arange(n) + first_b[group_a], np.arange(m) + end_a[group_b]
        ids, mark = np.empty(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        ids[slot_a], ids[slot_b] = self.a, self.b
        mark[slot_a[self.last_a]], mark[slot_b[self.last_b]] = ord("|"), ord(";")
        width = n_digits[ids]
        said = digits[ids]
        said[np.arange(n + m), width] = mark
        flat = said[np.arange(said.shape[1]) <= width[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(width + 1)])[self.from_a + self.from_b]
        return [flat[i : j - 1] if j > i else b"" for i, j in zip(at[:-1], at[1:], strict=True)]


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to size - 1 as bytes from the left, with one place more, and how many there are."""
    width = len(str(size - 1))
    said = np.array([str(i) for i in range(size)], f"S{width + 1}")
    return said.view(np.uint8).reshape(size, width + 1), np.char.str_len(said)


class Vocabularies:
    """What aligning needs to know of both vocabularies: the bytes of each token, and the ids in digits."""

    def __init__(self, path_a: str, path_b: str) -> None:
        pair = tokenizer_pair(path_a, path_b)
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in kept], np.int64) for kept in (pair.bytes_a, pair.bytes_b))
        self.digits = decimal_table(max(len(self.bytes_a), len(self.bytes_b)))


_VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _VOCABULARIES:
        _VOCABULARIES[path_a, path_b] = Vocabularies(path_a, path_b)
    return _VOCABULARIES[path_a, path_b]


def chunks(batches: Iterator[pa.RecordBatch], v: Vocabularies) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Rows of a token table in runs of about CHUNK_TOKENS (a longer text alone), aligned."""
    for batch in small(batches):
        ids_a, ids_b = batch.column("ids_a").to_pylist(), batch.column("ids_b").to_pylist()
        first, held = 0, 0
        for i in range(batch.num_rows + 1):
            here = (len(ids_a[i]) + len(ids_b[i])) // 4 if i < batch.num_rows else 0
            if i > first and (i == batch.num_rows or held + here > CHUNK_TOKENS):
                yield batch.slice(first, i - first), Aligned(ids_a[first:i], ids_b[first:i], v.bytes_a, v.bytes_b)
                first, held = i, 0
            held += here


def distinct_pairs(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, b, shard): each distinct linked pair. A task sends a pair again only after it has met half a million others."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for _, aligned in chunks(batches, vocabularies(path_a, path_b)):
            met = np.unique(aligned.pairs())
            fresh = np.setdiff1d(met, seen, assume_unique=True)
            if len(fresh):
                seen = np.union1d(seen, fresh) if len(seen) < 500_000 else met
                columns = [fresh.view(np.int64), (fresh & np.uint64(0xFFFFFFFF)).astype(np.int32), (mix(fresh) % np.uint64(SHARDS)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["pair", "b", "shard"])

    return tokens.select("ids_a", "ids_b").mapInArrow(find, "pair long, b int, shard int").distinct()


def _place(keys: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.asarray(bits, np.uint64)


def build_shard(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each level, the levels' bits as words, the keys in the order of their bits) of a minimal perfect hash."""
    sizes, words, in_order, left = [], [], [], np.sort(keys)
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("equal keys have no minimal perfect hash")
        bits = max(64, -(-int(len(left) * GAMMA_BITS) // 64) * 64)
        at = _place(left, len(sizes), bits)
        alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
        placed = alone[at]
        in_order.append(left[placed][np.argsort(at[placed])])
        words.append(np.packbits(alone, bitorder="little").tobytes())
        sizes.append(bits)
        left = left[~placed]
    return sizes, b"".join(words), np.concatenate([np.zeros(0, np.uint64), *in_order])


class PerfectHash:
    """Numbers 0 to len(keys) - 1 for the keys it was built of, -1 for all others."""

    def __init__(self, shards: list[tuple[list[int], bytes, np.ndarray]]) -> None:
        """shards: what build_shard gave for the keys of each shard, in order."""
        levels = max((len(sizes) for sizes, _, _ in shards), default=0)
        self.bits, self.start = np.zeros((levels, len(shards)), np.int64), np.zeros((levels, len(shards)), np.int64)
        at = 0
        for s, (sizes, _, _) in enumerate(shards):
            for level, bits in enumerate(sizes):
                self.bits[level, s], self.start[level, s] = bits, at
                at += bits
        self.words = np.frombuffer(b"".join(words for _, words, _ in shards), "<u8")
        self.keys = np.concatenate([np.zeros(0, np.uint64), *(keys for _, _, keys in shards)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, shard = np.arange(len(keys)), (mix(keys) % np.uint64(max(1, self.bits.shape[1]))).astype(np.int64)
        for level in range(len(self.bits)):
            bits = self.bits[level, shard[left]]
            left, bits = left[bits > 0], bits[bits > 0]
            at = self.start[level, shard[left]] + _place(keys[left], level, bits).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1  # the keys prove it
        return out


def blocks_of(pairs: DataFrame, block_pairs: int) -> list[tuple[int, int]]:
    """Ranges of second ids (first, last) with about block_pairs distinct pairs each; the driver gets one count for each id of the vocabulary."""
    out: list[tuple[int, int]] = []
    held = 0
    for r in sorted(pairs.groupBy("b").count().collect()):
        if out and held + r["count"] <= block_pairs:
            out[-1], held = (out[-1][0], r["b"]), held + r["count"]
        else:
            out.append((r["b"], r["b"]))
            held = r["count"]
    return out


def perfect_hash(pairs: DataFrame) -> PerfectHash:
    """The hash of a block of distinct pairs, built shard by shard in tasks."""

    def build(batch: pa.Table) -> pa.Table:
        sizes, words, keys = build_shard(batch.column("pair").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([batch.column("shard")[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": pa.array([words], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})

    shards: list[tuple[list[int], bytes, np.ndarray]] = [([], b"", np.zeros(0, np.uint64))] * SHARDS
    for r in pairs.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, words binary, keys binary").collect():
        shards[r["shard"]] = (r["sizes"], bytes(r["words"]), np.frombuffer(bytes(r["keys"]), np.uint64))
    return PerfectHash(shards)


def _summed(rows: DataFrame, branches: int) -> DataFrame:
    """(piece, branch, counts): vectors of a piece added up, FAN branches in a task, until each piece has one."""

    def add(batch: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(x.as_py(), np.int64) for x in batch.column("counts")))
        return pa.table({"piece": batch.column("piece").slice(0, 1).cast(pa.int32()), "branch": batch.column("branch").slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        branches = -(-branches // FAN)
        rows = rows.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy("piece", "branch").applyInArrow(add, "piece int, branch int, counts binary")
        if branches == 1:
            return rows


def pair_counts(tokens: DataFrame, path_a: str, path_b: str, shared: Broadcast) -> np.ndarray:
    """How many links hold each pair of the hash: a dense vector in each task, summed in a tree."""
    n = len(shared.value.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = shared.value, np.zeros(n, np.int64)
        for _, aligned in chunks(batches, vocabularies(path_a, path_b)):
            number = table(aligned.pairs())
            total += np.bincount(number[number >= 0], minlength=n)
        kept = [(i, total[at : at + PIECE]) for i, at in enumerate(range(0, n, PIECE))]
        kept = [(i, x.tobytes()) for i, x in kept if x.any()]
        branch = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int32()), pa.array([branch] * len(kept), pa.int32()), pa.array([x for _, x in kept], pa.binary())], ["piece", "branch", "counts"])

    rows = tokens.select("ids_a", "ids_b")
    out = np.zeros(n, np.int64)
    for r in _summed(rows.mapInArrow(count, "piece int, branch int, counts binary"), rows.rdd.getNumPartitions()).collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


class Counted:
    """A block's hash with the count of each pair and the highest count of each second id."""

    def __init__(self, table: PerfectHash, counts: np.ndarray) -> None:
        self.table, self.counts = table, counts
        b = (table.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        best = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
        np.maximum.at(best, b, counts)
        self.is_best = counts == best[b]


def _looked_up(tokens: DataFrame, path_a: str, path_b: str, shared: Broadcast, first: bool, groups: bool, links: bool) -> DataFrame:
    """The second pass over a block: what its pairs add to each row; with first, also what does not depend on counts."""
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("links", pa.int64()), ("best", pa.bool_())])
    names = ["row", "n_best", "count_sum", *["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"] * first, *["groups"] * (first and groups), *["links"] * links]
    kinds = {"row": "long", "doc_id": tokens.schema["doc_id"].dataType.simpleString(), "groups_sha256": "string", "groups": "string", "links": "array<struct<a:int,b:int,links:long,best:boolean>>"}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, counted = vocabularies(path_a, path_b), shared.value
        for batch, aligned in chunks(batches, v):
            pairs = aligned.pairs()
            number = counted.table(pairs)
            mine = number >= 0
            count, best = (np.where(mine, x[number], 0) if len(x) else np.zeros(len(pairs), np.int64) for x in (counted.counts, counted.is_best))
            of_row = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[aligned.from_link]), pa.int64())  # noqa: E731, B023
            out = {"row": batch.column("row"), "n_best": of_row(best), "count_sum": of_row(count)}
            if first:
                said = aligned.group_texts(*v.digits)
                digest = [hashlib.sha256(x).hexdigest() if x else "" for x in said]
                out |= {"doc_id": batch.column("doc_id"), "n_a": np.diff(aligned.from_a), "n_b": np.diff(aligned.from_b), "n_groups": np.diff(aligned.from_link), "groups_sha256": pa.array(digest, pa.string())}
                if groups:
                    out["groups"] = pa.array([x.decode() for x in said], pa.string())
            if links:
                each = [{"a": int(p >> np.uint64(32)), "b": int(p & np.uint64(0xFFFFFFFF)), "links": int(c), "best": bool(x)} for p, c, x in zip(pairs[mine], count[mine], best[mine], strict=True)]
                at = np.concatenate([[0], np.cumsum(mine)])[aligned.from_link]
                out["links"] = pa.array([each[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.list_(link))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in (out[n] for n in names)], names)

    return tokens.mapInArrow(look_up, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def align(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, links: bool = False, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs (doc_id, text; other columns are ignored).

    Tokenizer a is a byte-level one (a file of the tokenizers library) and reads space + text, b a model of sentence
    pieces that adds the space itself. A link is a token of each that end at one byte; links cut the text into groups.
    n_best counts the links whose pair is the commonest of its b id in all docs, ties included, count_sum adds up the
    pairs' counts. Null and empty texts, and texts whose bytes one tokenizer does not give back, have no tokens: zeros and
    ''. Each row counts, so rows may repeat or have no id. An empty table gives no rows.

    groups adds the text under groups_sha256; links adds (a, b, links, best) of each link, by block in the order of the text.
    A block has about block_pairs distinct pairs, more only if one b id has; each costs two passes over the token ids.
    """
    tokens = token_table(docs, path_a, path_b)
    pairs = distinct_pairs(tokens, path_a, path_b)
    folder = f"{shared_folder(docs.sparkSession)}/pairs-{uuid.uuid4().hex}"
    pairs.write.parquet(folder)
    pairs = docs.sparkSession.read.parquet(folder)
    spark, parts = docs.sparkSession, []
    blocks = blocks_of(pairs, block_pairs) or [(0, -1)]
    for i, (low, high) in enumerate(blocks):
        table = perfect_hash(pairs.where(F.col("b").between(low, high)))
        shared = spark.sparkContext.broadcast(table)
        counted = Counted(table, pair_counts(tokens, path_a, path_b, shared))
        shared.destroy()
        parts.append(_looked_up(tokens, path_a, path_b, spark.sparkContext.broadcast(counted), i == 0, groups, links))
    columns = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *["groups"] * groups, *["links"] * links]
    if len(parts) == 1:
        return parts[0].select(*columns)
    merge = {n: F.any_value(n, F.lit(True)).alias(n) for n in parts[0].columns if n not in ("row", "n_best", "count_sum", "links")}
    merge |= {n: F.sum(n).alias(n) for n in ("n_best", "count_sum")}
    if links:
        merge["links"] = F.flatten(F.collect_list("links")).alias("links")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).groupBy("row").agg(*merge.values()).select(*columns)
