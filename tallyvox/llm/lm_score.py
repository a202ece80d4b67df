"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

The counts of a corpus do not fit one machine, and neither do its tokens as rows. So texts are kept in units of
bounded size. Each unit sends its distinct unigrams and bigrams, sorted and packed, to the buckets that they fall in;
a bucket adds up what all units sent and answers each unit with the totals of just its own keys, in its own order.
Every unit then holds all counts that its texts need, as plain arrays.

A part of the training texts (fold EM_FOLD) is left out of the counts at first. On it expectation-maximisation learns
the weights of the three estimates for each bucket of context frequency, from counts of how often which estimates
met; scores then use the counts of all training texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAMMA, SPACED, Words, byte_chunks, cut, fold, mix, small, text_list

MODULUS, HELD_OUT, EM_FOLD = 7, 2, 3
#: Bytes of text in a unit, and so in a bucket's share of keys: a task's memory is about 20 times this.
UNIT_BYTES = 8 << 20
FIT, EM, HELD = 0, 1, 2
FREQUENCY_BUCKETS = 20
_END = np.uint64(0x5851F42D4C957F2D)
_UNI, _BI = np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _spread(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the gaps between them, byte by byte, so that the high bytes, nearly all zero, take no room."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return _squeeze(gaps.T)


def unpack_keys(raw: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(_spread(raw, np.uint8).reshape(8, -1).T).view("<u8")
    return np.cumsum(gaps[:, 0], dtype=np.uint64)


class Tokens:
    """The tokens of some texts, one end after each: unigram and bigram keys, and the offsets of the texts."""

    def __init__(self, texts: list[bytes]) -> None:
        uni, bi, counts = [], [], []
        for _, raws in byte_chunks([t.decode() for t in texts]):
            words = Words(raws, SPACED)
            n = np.diff(words.offsets)
            hashes = np.insert(words.hashes, words.offsets[1:], _END)
            before = np.roll(hashes, 1)
            before[np.concatenate([[0], np.cumsum(n + 1)[:-1]])] = _END  # a text begins after an end
            uni.append(mix(hashes ^ _UNI))
            bi.append(mix(before * GAMMA + hashes + _BI))
            counts.append(n + 1)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.uni, self.bi, self.n = join(uni, np.uint64), join(bi, np.uint64), join(counts, np.int64)


def units(docs: DataFrame, unit_bytes: int) -> DataFrame:
    """(unit, role, texts): the rows of docs in units of one role, their ids and texts as a compressed Arrow stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {FIT: [], EM: [], HELD: []}
        size: Counter[int] = Counter()

        def flush(role: int) -> pa.RecordBatch:
            nonlocal unit
            sink = pa.BufferOutputStream()
            ids, texts = zip(*held[role], strict=True)
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=schema))
            unit += 1
            held[role], size[role] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([role], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "role", "texts"])

        for batch in small(batches):
            for doc, role, text in zip(batch.column("doc_id").to_pylist(), batch.column("role").to_pylist(), text_list(batch), strict=True):
                raw = (text or "").encode()
                held[role].append((doc, raw))
                size[role] += len(raw) + 16
                if size[role] >= unit_bytes:
                    yield flush(role)
        for role in held:
            if held[role]:
                yield flush(role)

    part = fold("doc_id", MODULUS)
    role = F.when(part == HELD_OUT, HELD).when(part == EM_FOLD, EM).otherwise(FIT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role")).mapInArrow(gather, "unit long, role int, texts binary")


def _open(raw: bytes) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_stream(raw).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys: buckets are ranges of equal width."""
    width = -(-(1 << 64) // buckets)
    return np.concatenate([[0], np.searchsorted(keys, np.array([width * b for b in range(1, buckets)], np.uint64)), [len(keys)]])


def sent(stored: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, unit, role, keys, counts): what each unit holds of each bucket; kind 0 has unigrams, kind 1 bigrams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, role, raw in zip(*(batch.column(c).to_pylist() for c in ("unit", "role", "texts")), strict=True):
                tokens = Tokens(_open(raw)[1])
                for kind, keys in ((0, tokens.uni), (1, tokens.bi)):
                    distinct, n = np.unique(keys, return_counts=True)
                    bounds = _split(distinct, buckets)
                    full = [b for b in range(buckets) if bounds[b + 1] > bounds[b]]
                    parts = [slice(bounds[b], bounds[b + 1]) for b in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([unit] * len(full), pa.int64()), pa.array([role] * len(full), pa.int32()), pa.array([pack_keys(distinct[p]) for p in parts], pa.binary()), pa.array([_squeeze(n[p].astype("<u4")) for p in parts], pa.binary())],
                        ["kind", "bucket", "unit", "role", "keys", "counts"],
                    )

    return stored.mapInArrow(send, "kind int, bucket int, unit long, role int, keys binary, counts binary")


def totalled(parts: DataFrame) -> DataFrame:
    """(unit, kind, bucket, total, fitted, types, tokens, fit_tokens): for each unit the counts of its keys over all training texts, and over those outside the EM fold.

    The last three are filled in a row of unit -1 for each bucket of unigrams: types and tokens over all, and tokens fitted.
    """

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = key
        keys = [unpack_keys(k) for k in rows["keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts, roles = [_spread(c, np.uint32) for c in rows["counts"]], list(rows["role"])
        zero = lambda c, use: c.astype(float) if use else np.zeros(len(c))
        every = np.bincount(place, np.concatenate([zero(c, r != HELD) for c, r in zip(counts, roles, strict=True)]), len(distinct)).astype("<u8")
        fitted = np.bincount(place, np.concatenate([zero(c, r == FIT) for c, r in zip(counts, roles, strict=True)]), len(distinct)).astype("<u8")
        at, out = 0, []
        for unit, role, k in zip(rows["unit"], roles, keys, strict=True):
            own = place[at : at + len(k)]
            at += len(k)
            out.append((unit, kind, bucket, _squeeze(every[own]), _squeeze(fitted[own]) if role == EM else b"", 0, 0, 0))
        if kind == 0:
            out.append((-1, kind, bucket, b"", b"", int((every > 0).sum()), int(every.sum()), int(fitted.sum())))
        return pd.DataFrame(out, columns=["unit", "kind", "bucket", "total", "fitted", "types", "tokens", "fit_tokens"])

    return parts.groupBy("kind", "bucket").applyInPandas(add, "unit long, kind int, bucket int, total binary, fitted binary, types long, tokens long, fit_tokens long")


def _counts(texts: list[bytes], answers: pd.DataFrame, column: str) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a unit the counts of itself, of its context, and of both together."""
    tokens = Tokens(texts)
    answers = answers.sort_values(["kind", "bucket"])
    whole = [np.concatenate([np.zeros(0, np.uint64), *(_spread(x, np.uint64) for x in answers.loc[answers["kind"] == kind, column])]) for kind in (0, 1)]
    uni = whole[0][np.unique(tokens.uni, return_inverse=True)[1]]
    bi = whole[1][np.unique(tokens.bi, return_inverse=True)[1]]
    context = np.roll(uni, 1)
    ends = np.cumsum(tokens.n)
    context[ends - tokens.n] = uni[ends - 1] if len(ends) else 0  # of the end before a text
    return tokens, uni.astype(float), context.astype(float), bi.astype(float)


def _levels(context: np.ndarray) -> np.ndarray:
    """Buckets of context frequency: 0 for unseen contexts, else one for each doubling."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), FREQUENCY_BUCKETS - 1).astype(np.int64)


def learn_weights(met: list[tuple[int, int, int, int]], rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by bucket of context frequency, by expectation-maximisation.

    met has (bucket, q2, q1, n): n held-out tokens whose bigram and unigram estimates are 2 ** (q / 4) times the
    uniform one; q of -999 stands for an estimate of zero. A bucket without tokens has the weights of all tokens.
    """
    level, q2, q1, n = (np.array(x, float) for x in zip(*met, strict=True)) if met else (np.zeros(0),) * 4
    ratio = np.stack([np.where(q > -999, 2 ** (np.maximum(q, -999) / 4), 0) for q in (q2, q1)] + [np.ones(len(n))], axis=1)

    def em(mine: np.ndarray, seen: bool) -> np.ndarray:
        w = np.array([0.4, 0.5, 0.1]) if seen else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            shares = ratio[mine] * w
            shares *= (n[mine] / shares.sum(axis=1))[:, None]
            w = (shares.sum(axis=0) + 1e-3 * w) / (n[mine].sum() + 1e-3)
        return w

    out = np.empty((FREQUENCY_BUCKETS, 3))
    for k in range(FREQUENCY_BUCKETS):
        mine = level == k
        out[k] = em(mine if mine.any() else level > 0 if k else level >= 0, k > 0)
    return out


def scores(docs: DataFrame, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts are one token, the end. Rows of fold HELD_OUT are not learned from; a null doc_id is learned
    from. Rows that repeat count and are scored each time. Without any training token base and model are uniform; an
    empty table gives no rows. For the weights the estimates of held-out tokens are rounded to quarters of a binary
    order, which bounds what the driver gets; scores use unrounded estimates.

    Rows that are shuffled: one for each unit and bucket that meet, so at most units * buckets, and at most one for
    each distinct key of each unit, which is what it comes to when buckets are far more than a unit's keys.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    buckets = max(1, math.ceil(size / unit_bytes))
    stored = cut(units(docs, unit_bytes))
    totals = cut(totalled(sent(stored, buckets)))
    facts = totals.where("unit = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "fit_tokens")]).first()
    types, tokens_all, tokens_fit = facts["types"], facts["tokens"], facts["fit_tokens"]
    uniform = 1 / (types + 1)

    def meet(key: tuple, unit: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["level", "q2", "q1", "n"]
        if not len(unit):
            return pd.DataFrame({c: [] for c in columns})
        _, uni, context, bi = _counts(_open(unit["texts"].iloc[0])[1], answers, "fitted")
        q = lambda top, below: np.where((top > 0) & (below > 0), np.round(4 * np.log2(np.maximum(top, 1) / np.maximum(below, 1) / uniform)), -999).astype(np.int64)
        rows, n = np.unique(np.stack([_levels(context), q(bi, context), q(uni, np.full(len(uni), tokens_fit))]), axis=1, return_counts=True)
        return pd.DataFrame({"level": rows[0], "q2": rows[1], "q1": rows[2], "n": n})

    answers = totals.where("unit != -1").drop("types", "tokens", "fit_tokens")
    em_units = stored.where(F.col("role") == EM)
    met = em_units.groupBy("unit").cogroup(answers.where("length(fitted) > 0").groupBy("unit")).applyInPandas(meet, "level long, q2 long, q1 long, n long")
    weights = learn_weights([tuple(r) for r in met.groupBy("level", "q2", "q1").agg(F.sum("n")).collect()])  # a grid: 20 levels, and q in steps of a quarter over the 60 binary orders of counts

    def score(key: tuple, unit: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _open(unit["texts"].iloc[0])
        tokens, uni, context, bi = _counts(texts, answers, "total")
        starts = np.cumsum(tokens.n) - tokens.n
        w = weights[_levels(context)]
        p = w[:, 0] * bi / np.maximum(context, 1) + w[:, 1] * uni / max(tokens_all, 1) + w[:, 2] * uniform
        base = np.log10((uni + 1) / (tokens_all + types + 1))
        return pd.DataFrame(
            {"doc_id": pd.array(ids, "Int64"), "held_out": int(unit["role"].iloc[0]) == HELD, "n_tokens": tokens.n, "n_known": np.add.reduceat((uni > 0).astype(np.int64), starts), "train_tokens": int(tokens_all), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300)), starts)}
        )

    return stored.groupBy("unit").cogroup(answers.drop("fitted").groupBy("unit")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
