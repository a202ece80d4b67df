"""A quality classifier with supervised subword embeddings.

A text is the mean of the vectors of its hashed tokens: words, pairs of neighbouring words, character 3- and
5-grams inside words, and marks for repeated words. A softmax layer over that mean gives the class. Vectors and
layer are trained together by stochastic gradient descent in numpy. Both are linear, so a trained model is kept as
one number for each bucket, its vector times the difference of the two output rows, and scoring takes a mean of
these numbers: the same value as from the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, byte_chunks, mix, small, text_list

BITS, DIM = 16, 12
_C1, _C2, _C3, _C4 = (np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1))
_BYTES = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SHIFT = np.uint32(32 - BITS)


def tokens(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of the text) of each kind of token, over whole texts; case counts."""
    words = Words(raws, SPACED, lower=False)
    n = len(words.hashes)
    if not n:
        return
    owner = np.repeat(np.arange(len(raws)), np.diff(words.offsets))
    bucket = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    yield bucket(mix(words.hashes)), owner
    pair = owner[1:] == owner[:-1]
    yield bucket(mix(words.hashes[1:] * np.uint64(3) + words.hashes[:-1]))[pair], owner[1:][pair]
    for lag in (1, 2, 3):
        again = (words.hashes[lag:] == words.hashes[:-lag]) & (owner[lag:] == owner[:-lag])
        for twice in range(1, 5):  # marks weigh more than one of many tokens
            yield np.full(int(again.sum()), lag * 8 + twice), owner[lag:][again]
    buf = np.frombuffer(b"\n" + words.data, np.uint8)
    space = SPACED[buf]
    text_of = np.repeat(np.arange(len(raws)), [len(r) + 1 for r in raws])  # of each byte but the first
    t = _BYTES[np.where(space, np.uint8(32), buf)]
    h = t[:-2] + t[1:-1] * _C1 + t[2:] * _C2
    inner = ~space[1:-1]
    yield ((h * _C3) >> _SHIFT)[inner].astype(np.int64), text_of[: len(h)][inner]
    if len(buf) >= 5:
        h = h[:-2] + t[3:-1] * _C3 + t[4:] * _C4
        inner = ~(space[1:-3] | space[2:-2] | space[3:-1])
        yield ((h * _C1) >> _SHIFT)[inner].astype(np.int64), text_of[: len(h)][inner]


def train(raws: list[bytes], labels: list[int], epochs: int = 4, rate: float = 0.6, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights for each bucket and a bias, learned from labelled texts. Without both labels the score is a constant."""
    y = np.asarray(labels, int)
    weights = np.zeros(1 << BITS, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return weights, 0.0 if len(y) == 0 else (2.0 if y[0] else -2.0)
    docs = []
    for raw in raws:
        found = [b for b, _ in tokens([raw])]
        at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        docs.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    order, done, steps = np.arange(len(docs)), 0, epochs * len(docs)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            at, share = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[at]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, mean)
            bias -= step * p
            # each vector takes its share of the gradient, scaled up as rare tokens would else hardly move
            vectors[at] -= (step * len(at) ** 0.5 * share)[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def margins(raws: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The difference of the two outputs for each text; the bias alone for texts without tokens."""
    total, count = np.zeros(len(raws)), np.zeros(len(raws))
    for at, owner in tokens(raws):
        total += np.bincount(owner, weights[at], len(raws))
        count += np.bincount(owner, minlength=len(raws))
    return bias + total / np.maximum(count, 1)


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Train on a bounded sample (doc_id, text, y) in one task (see common.labelled_sample); the driver gets the model only."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "y": []}), *batches]).sort_values(["doc_id", "y"])
        weights, bias = train([t.encode() if isinstance(t, str) else b"" for t in held["text"]], [int(v) for v in held["y"]])
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    row = sample.repartition(1).mapInPandas(one, "weights binary, bias double").collect()[0]
    return np.frombuffer(bytes(row["weights"]), np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1, null and empty texts too) and predicted (score >= threshold) to every row; other columns stay, but for two of these names.

    Each row is scored by its text alone, so rows may repeat and equal texts get equal scores; a score of just the
    threshold is predicted as 1. An empty table stays empty. A model that was trained without both labels gives one
    score to all texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in small(batches):
            out = [margins(raws, weights, bias) for _, raws in byte_chunks(text_list(batch, text_col))]
            z = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
