"""Helpers shared by the training-data operators: sessions, tables, Arrow batches and word hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAMMA = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir where it is set. A session whose tasks run in the driver's process gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so that later jobs neither recompute nor depend on one executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split that decides which rows may be learned from."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % modulus


def _usable(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y): labels that may be learned from, once for each doc_id; those of the held-out fold, null ones and ids with both labels are left out."""
    known = labels.where((fold("doc_id", modulus) != held_out) & F.col("doc_id").isNotNull()).where(F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("other")).where("y = other").drop("other")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, text, y) for every row of docs whose label 0 or 1 may be learned from.

    Rows whose fold is held_out are never taken, nor null labels or ids. A doc_id with both labels is left out, as nobody
    can tell which is meant; a label that is said twice counts once. Rows of docs that repeat an id are all taken.
    As many labels as documents may be meant, so they are never broadcast.
    """
    return docs.select("doc_id", "text").join(_usable(labels, label, modulus, held_out).where("y IN (0, 1)").hint("merge"), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, text, y) for at most per_class rows of labels with label 1 and as many with label 0, those of the smallest id hash.

    Rows are left out as by labelled_rows. With an empty table of labels the sample is empty. The ids are chosen from
    the small table first, so that only the chosen texts move, and the broadcast side has at most 2 * per_class rows.
    """
    usable = _usable(labels, label, modulus, held_out)
    one = lambda y: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = one(1).unionByName(one(0))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def byte_chunks(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts as UTF-8 (null: empty) of about limit bytes, with the first index of each; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8") if text else b""
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most rows: what a Python worker holds at once, beside the batch that Spark sent."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _byte_values() -> np.ndarray:
    return mix((np.arange(1, 257, dtype=np.uint64)) * GAMMA) | np.uint64(1)


BYTE_VALUES = _byte_values()
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, np.uint64(0xD6E8FEB86659FD93))]).cumprod(dtype=np.uint64)
    return _POWERS[0][:n]


def separators(*keep: bytes) -> np.ndarray:
    """For each byte, whether it separates words: true for those not kept."""
    out = np.ones(256, bool)
    out[list(b"".join(keep))] = False
    return out


#: Words are what ASCII white space (0x20, 0x09-0x0D) leaves.
SPACED = ~separators(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and non-ASCII bytes.
ALNUM = separators(bytes(range(0x30, 0x3A)), bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100)))


class Words:
    """The words of some texts: where each starts and ends in data, a 64-bit hash of each, and offsets[i]:offsets[i+1] for text i."""

    def __init__(self, raws: list[bytes], seps: np.ndarray, lower: bool = True) -> None:
        joined = b"\n".join(raws) + b"\n"
        self.data = joined.lower() if lower else joined  # bytes.lower() touches A-Z only
        buf = np.frombuffer(self.data, np.uint8)
        word = ~seps[buf]
        edge = np.flatnonzero(np.diff(word, prepend=False))  # the text ends with a separator, so edges pair up
        self.starts, self.ends = edge[::2], edge[1::2]
        ends = np.cumsum([len(r) + 1 for r in raws])
        self.offsets = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        lengths = self.ends - self.starts
        if not len(lengths):
            self.hashes = np.zeros(0, np.uint64)
            return
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        chars = BYTE_VALUES[buf[word]]
        rel = np.arange(len(chars)) - np.repeat(first, lengths)
        self.hashes = mix(np.add.reduceat(chars * powers(int(lengths.max()))[rel], first) + lengths.astype(np.uint64) * GAMMA)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
