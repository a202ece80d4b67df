"""Benchmark decontamination: find every test passage of ten words in the training texts.

The windows of the test items are normalised and hashed; a block of them, of bounded size, is broadcast as a sorted
array with a bitmap before it. Tasks hash every window of whole training texts with array operations, look them up
and compare the words of each hit. A larger benchmark takes more blocks, one pass each, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, GAMMA, Words, byte_chunks, cut, mix, small, text_list

#: Windows in a broadcast block: at about 200 bytes each some 200 MB at most, far less for usual benchmarks.
BLOCK_WINDOWS = 500_000
_MAP_BITS = 20


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = out * GAMMA + h[i : i + len(out)]
    return mix(out + np.uint64(size))


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(hash, size, words, item_id): each distinct window of each item."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = batch.column("item_id").to_pylist()
            for first, raws in byte_chunks(text_list(batch)):
                words, rows = Words(raws, ALNUM), set()
                for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
                    run = min(size, b - a)
                    if run:
                        for k, h in enumerate(run_hashes(words.hashes[a:b], run)):
                            rows.add((int(h.view(np.int64)), int(run), b" ".join(words.word(a + k + j) for j in range(run)), ids[first + i]))
                yield pa.RecordBatch.from_pylist([dict(zip(("hash", "size", "words", "item_id"), r, strict=True)) for r in sorted(rows, key=str)], pa.schema([("hash", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("item_id", pa.string())]))

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut_up, "hash long, size int, words binary, item_id string").distinct()


class Lookup:
    """Windows of one size: a bitmap that few others pass, and what each hash stands for."""

    def __init__(self, rows: list) -> None:
        self.keys: dict[int, list[tuple[bytes, list[str]]]] = {}
        items = defaultdict(list)
        for r in rows:
            items[r["hash"], bytes(r["words"])].append(r["item_id"])
        for (h, words), ids in items.items():
            self.keys.setdefault(h, []).append((words, ids))
        self.sorted = np.sort(np.fromiter(self.keys, np.int64, len(self.keys)).view(np.uint64))
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[self.sorted >> np.uint64(64 - _MAP_BITS)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[h >> np.uint64(64 - _MAP_BITS)])
        place = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[place] == h[at]]


def _block(windows: DataFrame) -> Broadcast:
    """The lookups of a block of windows, of at most about block_windows rows, on every executor."""
    by_size = defaultdict(list)
    for r in windows.collect():
        by_size[r["size"]].append(r)
    return windows.sparkSession.sparkContext.broadcast({n: Lookup(x) for n, x in sorted(by_size.items())})


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """For each row of docs: n_words, the hit runs of words (start, end, with their byte offsets in the UTF-8 text) and the items."""
    run = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())])
    names = [*docs.columns, "n_words", "runs", "items"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts, runs, items = [], [], []
            for _, raws in byte_chunks(text_list(batch)):
                words = Words(raws, ALNUM)
                bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
                first_runs, first_items = len(runs), len(items)
                runs += [[] for _ in raws]
                items += [set() for _ in raws]
                counts += np.diff(words.offsets).tolist()
                marks = defaultdict(list)
                for size, lookup in shared.value.items():
                    h = run_hashes(words.hashes, size)
                    for i in lookup.hits(h):
                        doc = int(np.searchsorted(words.offsets, i, side="right")) - 1
                        if i + size > words.offsets[doc + 1]:
                            continue  # it would reach into the next text
                        said = b" ".join(words.word(i + j) for j in range(size))
                        for text, ids in lookup.keys[int(h[i].view(np.int64))]:
                            if text == said:
                                items[first_items + doc].update(x for x in ids if x is not None)
                                marks[doc].append((int(i), int(i) + size))
                for doc, found in marks.items():
                    joined: list[list[int]] = []
                    for a, b in sorted(found):
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(b, joined[-1][1])
                        else:
                            joined.append([a, b])
                    base, at = words.offsets[doc], bounds[doc]
                    runs[first_runs + doc] = [{"first": int(a - base), "end": int(b - base), "from_byte": int(words.starts[a] - at), "to_byte": int(words.ends[b - 1] - at)} for a, b in joined]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names)

    extra = "n_words long, runs array<struct<first:long,end:long,from_byte:long,to_byte:long>>, items array<string>"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(extra).fields])
    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window_words: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, runs (word and byte ranges inside any occurrence of a window) and items (ids as sorted strings) added.

    An item of fewer words is one window; one without words has none. A benchmark row without item_id is looked for like any other, but has no name to stand in items. Null and empty texts have no words. Columns of
    docs with these names are replaced. Several blocks are joined by a row key that a checkpoint fixes, so doc_id may be
    null or repeat; they are scanned one after the other, and each but the first is dropped once its hits are written,
    so neither the driver nor an executor holds more than two blocks, however large the benchmark is. An empty table of
    documents stays empty; with an empty benchmark no row has hits.
    """
    docs = docs.drop("n_words", "runs", "items")
    windows = _windows(benchmark, window_words)
    windows = cut(windows)
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    if blocks == 1:
        return _scan(docs, _block(windows))
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    first, *others = [windows.where(F.pmod("hash", F.lit(blocks)) == i) for i in range(blocks)]
    found = []
    for block in others:
        shared = _block(block)
        found.append(cut(_scan(keyed, shared).where(F.size("runs") > 0).select(key, "runs", "items")))
        shared.destroy()
    hits = reduce(DataFrame.unionByName, found)
    more = hits.groupBy(key).agg(F.flatten(F.collect_list("runs")).alias("runs2"), F.flatten(F.collect_list("items")).alias("items2"))
    whole = _scan(keyed, _block(first)).join(more, key, "left").select(
        *docs.columns,
        "n_words",
        F.when(F.col("runs2").isNull(), F.col("runs")).otherwise(F.concat("runs", "runs2")).alias("runs"),
        F.when(F.col("items2").isNull(), F.col("items")).otherwise(F.array_sort(F.array_union("items", "items2"))).alias("items"),
    )
    merge = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"), F.element_at(acc, -1)["from_byte"].alias("from_byte"), F.greatest(F.element_at(acc, -1)["to_byte"], x["to_byte"]).alias("to_byte")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return whole.withColumn("runs", F.aggregate(F.array_sort("runs"), F.array().cast("array<struct<first:long,end:long,from_byte:long,to_byte:long>>"), merge))


def n_hit() -> F.Column:
    """Words inside any occurrence of a window."""
    return F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the result of contamination()."""
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


def remove_spans(found: DataFrame) -> DataFrame:
    """Cut the hit ranges out of text; a null text stays null, clean texts stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text, runs in zip(text_list(batch), batch.column("runs").to_pylist(), strict=True):
                if text and runs:
                    raw, at, kept = text.encode(), 0, []
                    for r in runs:
                        kept.append(raw[at : r["from_byte"]])
                        at = r["to_byte"]
                    text = b"".join([*kept, raw[at:]]).decode(errors="replace")
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return found.mapInArrow(clean, found.schema).drop("n_words", "runs", "items")


def remove_documents(found: DataFrame) -> DataFrame:
    """Only the rows without a hit."""
    return found.where(F.size("runs") == 0).drop("n_words", "runs", "items")
