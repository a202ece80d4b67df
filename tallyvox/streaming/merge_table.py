"""A keyed Parquet table that is merged when it is read: batches append deltas, compaction folds them in by bucket.

table/delta/seq=N/_bucket=B holds the rows that batch N brought, at most one a key; rows marked deleted are tombstones.
table/base/seq=N/_bucket=B holds a bucket's rows as of batch N. A folder of a seq counts once Spark has marked it as
complete. A read takes each bucket's newest base and the deltas after it; only buckets with such deltas are merged. A
batch writes what it brings; a bucket is written anew once its deltas have grown to a share of its base, so the bytes
written over a table's life stay in proportion to the bytes that came.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.products import keep_first

BUCKETS = 64
#: Bytes of deltas for a byte of base from which a bucket is written anew.
COMPACT_AT = 0.5
DELETED, BUCKET, SEQ = "_deleted", "_bucket", "seq"
_PATH = re.compile(rf"/(delta|base)/{SEQ}=(\d+)/(?:{BUCKET}=(\d+)/[^/]+|_SUCCESS)$")


@dataclass
class State:
    """What a table's folders hold: bytes by (seq, bucket), of complete folders only."""

    delta: dict[tuple[int, int], int] = field(default_factory=lambda: defaultdict(int))
    base: dict[tuple[int, int], int] = field(default_factory=lambda: defaultdict(int))

    def newest_base(self) -> dict[int, int]:
        """The seq of each bucket's newest base."""
        out: dict[int, int] = {}
        for seq, bucket in self.base:
            out[bucket] = max(seq, out.get(bucket, -1))
        return out

    def pending(self) -> dict[int, list[int]]:
        """For each bucket with deltas after its base, their seqs."""
        newest, out = self.newest_base(), defaultdict(list)
        for seq, bucket in sorted(self.delta):
            if seq > newest.get(bucket, -1):
                out[bucket].append(seq)
        return dict(out)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table_state(spark: SparkSession, table: str, before: int | None = None) -> State:
    """The table's folders, by one listing; with before as they were when that batch began."""
    fs, root = _file_system(spark, table)
    state, complete, found = State(), set(), []
    if not fs.exists(root):
        return state
    files = fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        m = _PATH.search(f.getPath().toString())
        if m and m[3] is None:
            complete.add((m[1], int(m[2])))
        elif m:
            found.append((m[1], int(m[2]), int(m[3]), f.getLen()))
    for kind, seq, bucket, size in found:
        if (kind, seq) in complete and (before is None or seq < before):
            getattr(state, kind)[seq, bucket] += size
    return state


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_delta(rows: DataFrame, table: str, seq: int, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Add what a batch brings under its number: of each key the last row in order. Rows without a key go; rows whose column _deleted is true take their key out. A batch that is written again gives the same table."""
    if DELETED not in rows.columns:
        rows = rows.withColumn(DELETED, F.lit(False))
    last = keep_first(rows.where(F.col(key).isNotNull()), [key], [F.desc_nulls_last(c) for c in order])
    last.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{table}/delta/{SEQ}={seq}")


def _read(spark: SparkSession, table: str, kind: str, folders: list[tuple[int, int]]) -> DataFrame | None:
    """Rows of some (seq, bucket) folders, with seq and bucket; columns that older files lack are null."""
    if not folders:
        return None
    paths = [f"{table}/{kind}/{SEQ}={seq}/{BUCKET}={bucket}" for seq, bucket in folders]
    return spark.read.option("basePath", f"{table}/{kind}").option("mergeSchema", True).parquet(*paths)


def _merged(spark: SparkSession, table: str, key: str, state: State, buckets: list[int]) -> list[DataFrame]:
    """The rows of some buckets: as they stand in the base where nothing came after, else the last of each key."""
    newest, pending = state.newest_base(), state.pending()
    still = [(newest[b], b) for b in buckets if b in newest and b not in pending]
    moved = [b for b in buckets if b in pending]
    out = [df.drop(SEQ) for df in [_read(spark, table, "base", still)] if df is not None]
    parts = [_read(spark, table, "base", [(newest[b], b) for b in moved if b in newest]), _read(spark, table, "delta", [(s, b) for b in moved for s in pending[b]])]
    parts = [p for p in parts if p is not None]
    if parts:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        last = rows.groupBy(BUCKET, key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, SEQ, BUCKET)]), SEQ).alias("r"))
        out.append(last.select(BUCKET, key, "r.*").where(~F.coalesce(DELETED, F.lit(False))))
    return out


def is_empty(spark: SparkSession, table: str, before: int | None = None) -> bool:
    """Whether no batch is complete yet."""
    state = table_state(spark, table, before)
    return not (state.delta or state.base)


def read_table(spark: SparkSession, table: str, key: str = "review_id", before: int | None = None) -> DataFrame:
    """The table as of the last complete batch, or as of the one before a batch, one row a key. A batch's number must not be compacted yet to be looked back over."""
    state = table_state(spark, table, before)
    buckets = sorted({b for _, b in [*state.base, *state.delta]})
    if not buckets:
        raise ValueError(f"nothing has been written to {table}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _merged(spark, table, key, state, buckets)).drop(DELETED, BUCKET)


def compact(spark: SparkSession, table: str, key: str = "review_id", at: float = COMPACT_AT, before: int | None = None) -> list[int]:
    """Write the buckets anew whose deltas (of batches under before, if it is named) have reached at times their base; returns them. Tombstones end here."""
    state = table_state(spark, table, before)
    newest = state.newest_base()
    due = [b for b, seqs in state.pending().items() if sum(state.delta[s, b] for s in seqs) >= at * state.base.get((newest.get(b, -1), b), 0)]
    if due:
        seq = max(s for s, _ in state.delta)
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _merged(spark, table, key, state, due)).drop(DELETED)
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{table}/base/{SEQ}={seq}")
    return due


def drop_superseded(spark: SparkSession, table: str, before: int) -> int:
    """Remove the deltas and bases of batches under before that no read of the present state takes; returns how many folders went. Choose before so old that no reader still works on them."""
    state = table_state(spark, table)
    newest, pending = state.newest_base(), state.pending()
    live = {("base", s, b) for b, s in newest.items()} | {("delta", s, b) for b, seqs in pending.items() for s in seqs}
    gone = 0
    for kind in ("delta", "base"):
        for seq in {s for s, _ in getattr(state, kind) if s < before}:
            if not any((kind, s, b) in live for s, b in getattr(state, kind) if s == seq):
                fs, path = _file_system(spark, f"{table}/{kind}/{SEQ}={seq}")
                fs.delete(path, True)
                gone += 1
    return gone


def stream_upsert(incoming: DataFrame, out: str, order: list[str], checkpoint: str, buckets: int = BUCKETS, key: str = "review_id", compact_at: float = COMPACT_AT) -> StreamingQuery:
    """Keep a merged table with one row for each key, the last that arrived; of one batch the last in order; see read_table.

    Each batch appends its rows under its number, so a batch that is repeated after a failure changes nothing, and
    buckets are compacted by size after it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, out, batch_id, key, order, buckets)
        compact(batch.sparkSession, out, key, compact_at)

    return incoming.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
