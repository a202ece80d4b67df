"""Importance resampling towards a target distribution.

Word runs fall into buckets by their checksum; a bucket's gain is the log ratio of its smoothed shares in the target and
in the corpus. Tasks count and score with arrays of one entry a bucket, the only thing that goes to them. A document's
score is its summed gain plus a Gumbel draw from its id, so taking the highest scores samples without replacement in
proportion to the weights. The cutoff is bracketed by a quantile sketch; exact counts of what lies outside prove the
bracket or widen it, and only the rows inside are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, byte_chunks, cut, small, text_list

#: Words over this many bytes take their checksum one by one.
LONG_WORD = 64
#: Rows of a sorted part, about.
PART_ROWS = 100_000
#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def _table() -> np.ndarray:
    """The checksum step for each byte (reflected polynomial 0xEDB88320)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


STEP = _table()


def advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The running CRC-32 of each word, from state on, over buf[start:end]; all words take a byte at a time together."""
    lengths = ends - starts
    clipped = -np.minimum(lengths, LONG_WORD + 1)
    order = np.argsort(clipped, kind="stable")
    at, c, clipped = starts[order], state[order], clipped[order]
    long = int(np.searchsorted(clipped, -LONG_WORD, side="left"))  # longer ones come first
    active = np.searchsorted(clipped, -np.arange(1, LONG_WORD + 1), side="right")
    for j, n in enumerate(active):
        if n <= long:
            break
        part = c[long:n]
        c[long:n] = STEP[(part ^ buf[at[long:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(long):
        c[i] = zlib.crc32(buf[at[i] : at[i] + lengths[order[i]]], int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def runs(words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length up to longest: the number of each run's first word, and the CRC-32 of its words joined by one space."""
    buf = np.frombuffer(words.data, np.uint8)
    n = len(words.starts)
    last = np.repeat(words.offsets[1:], np.diff(words.offsets))  # the end of each word's text
    first, state = np.arange(n), np.full(n, 0xFFFFFFFF, np.uint32)
    for size in range(1, longest + 1):
        if size > 1:
            keep = first + size <= last[first]
            first, state = first[keep], state[keep]
            state = STEP[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        word = first + size - 1
        state = advance(state, buf, words.starts[word], words.ends[word])
        yield first, state ^ np.uint32(0xFFFFFFFF)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): the features of all texts by bucket. Each task adds up one array and sends a row for each bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small(batches):
            for _, raws in byte_chunks(text_list(batch)):
                for _, crc in runs(Words(raws, ALNUM), longest):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """floor(1000 * ln(target share / corpus share)) of each bucket, both with one more in each bucket. At most two rows a bucket come to the driver."""
    both = bucket_counts(target, buckets, longest).withColumn("side", F.lit(0)).unionByName(bucket_counts(docs, buckets, longest).withColumn("side", F.lit(1)))
    n = np.zeros((2, buckets), np.int64)
    for r in both.collect():
        n[r["side"], r["bucket"]] = r["n"]
    of_target, of_docs = (int(x) + buckets for x in n.sum(axis=1))
    return np.array([math.floor(1000 * math.log(((t + 1) * of_docs) / ((s + 1) * of_target))) for t, s in zip(*n.tolist(), strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel draw, rounded down, from the sha256 of the seed and the id as text (null: empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_words, n_features, weights = [], [], []
            for _, raws in byte_chunks(text_list(batch)):
                words = Words(raws, ALNUM)
                features, weight = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
                for first, crc in runs(words, longest):
                    at = np.searchsorted(first, words.offsets)
                    summed = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                    features += np.diff(at)
                    weight += np.diff(summed[at])
                n_words.append(np.diff(words.offsets))
                n_features.append(features)
                weights.append(weight)
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    found = docs.select("doc_id", "text")
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return found.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def order() -> list[Column]:
    """Highest scores first, ties to the smaller id (null last), equal rows by their number."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """rows with their place (1, 2, ...) in order(). They are sorted in ranges of about PART_ROWS and written; the driver gets one count a range."""
    ordered = cut(rows.repartitionByRange(max(8, n // PART_ROWS), *order()).sortWithinPartitions(*order()))
    marked = ordered.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", _ROW_BITS)
    before, offsets = 0, []
    for r in sorted(marked.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return marked.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1) + 1).drop("part", "before", "at")


def bracket(scores: DataFrame, n: int, k: int, accuracy: int) -> tuple[int, int, int, int]:
    """(low, high, above, inside): scores from low to high hold the k-th highest of n; above lie over high, inside in between.

    The sketch names low and high two of its errors to either side of the k-th. Exact counts tell whether it is right;
    where it is not, the sides move out to double the distance, to the extremes in the end.
    """
    away = 2 / accuracy
    while True:
        ends = [max(0.0, 1 - k / n - away), min(1.0, 1 - k / n + away)]
        low, high = scores.agg(F.percentile_approx("score", ends, accuracy)).first()[0]
        low, high = (low if ends[0] > 0 else -(1 << 62)), (high if ends[1] < 1 else 1 << 62)
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above, inside
        away *= 2


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, min_words: int = 20, seed: int = 2024, accuracy: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for every row of docs (doc_id, text; other columns are ignored).

    rank counts from 1 over the floor(percent * N / 100) highest scores of the N rows with at least min_words words and
    is null for all others. Null and empty texts have no words, no features and weight 0. Rows that repeat an id are
    rows of their own, with the same draw; ties go to the smaller doc_id, a null one last, equal rows one after the
    other. An empty corpus gives no rows; an empty target makes common buckets lose and rare ones gain. weight and
    score are kept in the checkpoint folder (a few numbers a row), so texts are read twice in all.
    """
    gain = gains(docs, target, buckets, longest)
    scored = cut(weighed(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    eligible = scored.where(able)
    n = eligible.count()
    k = percent * n // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*columns, undrawn)
    low, high, above, inside = bracket(eligible, n, k, accuracy)
    last = numbered(eligible.where(F.col("score").between(low, high)), inside).where(F.col("rank") == k - above).select("score", "doc_id", "row").first()
    same_id = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
    earlier_id = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(False))
    drawn = able & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (earlier_id | (same_id & (F.col("row") <= last["row"])))))
    return scored.where(~drawn).select(*columns, undrawn).unionByName(numbered(scored.where(drawn), k).select(*columns, "rank"))


def oracle(buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> str:
    """The result of op11 in SQL; the checksum is folded over the bytes of each distinct word."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
b AS (SELECT {words} AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
k AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
u AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
h AS (SELECT w, hex(encode(w)) AS x FROM u),
v AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, y: xor(c >> 8, k.tab[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % {buckets} AS bucket FROM h, k),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + {buckets} AS sa, (SELECT coalesce(sum(t), 0) FROM t) + {buckets} AS ta),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * sa)::DOUBLE / ((s + 1) * ta)::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
q AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM q WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {percent} // 100 FROM p) THEN place END AS rank FROM q LEFT JOIN p USING (r)
"""
