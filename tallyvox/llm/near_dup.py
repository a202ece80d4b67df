"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

1. Each text becomes a set of shingle hashes. SuperMinHash gives it one value for each of BANDS * ROWS places: every
   element walks its own random permutation of the places, in step j offering j plus a random fraction, so that the
   ranks of one element over the places are correlated and the estimate varies less than with independent minima.
   A text is done as soon as no later step could lower any place, after a few steps for all but short texts.
2. Texts with equal sets (a digest of the whole set) stand behind one representative, so that thousands of copies
   cost one row from here on.
3. Representatives that agree on a band meet in a bucket. First each is tested against the smallest of its bucket, a
   number of pairs in proportion to the rows. Union-find joins what passes. Then, only where a bucket still holds
   several groups, pairs of different groups are tested: pairs inside a group cannot change the result. They meet by
   size class, as sets that are alike have nearly equal sizes, and a large bucket is dealt to many tasks, so that it
   is no single task's work. A parity sketch of each set first rules out pairs that cannot be alike enough: every
   element in just one of two sets turns one bit, so that the sketches never differ in more bits than the sets differ
   in elements.
4. A test compares the full sets. Union-find runs in every partition over its own links, and large-star / small-star
   rounds join the partitions' forests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAMMA, SPACED, Words, byte_chunks, cut, list_array, mix, small, text_list

BANDS, ROWS = 36, 5
SKETCH_BITS = 2048
#: Rows of a bucket for each part that its pairs are dealt to.
SPLIT = 1000
_HIGH, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def superminhash(elements: np.ndarray, offsets: np.ndarray, places: int) -> np.ndarray:
    """Signatures, one row of places for each set elements[offsets[i]:offsets[i+1]]; those of empty sets hold the largest value."""
    n = len(offsets) - 1
    sig = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    owner, walk, order = np.repeat(np.arange(n), np.diff(offsets)), elements, None
    for j in range(places):
        draw = mix(walk + np.uint64((j + 1) * int(GAMMA) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((draw >> _HIGH) * np.uint64(places - j)) >> _HIGH).astype(np.int64)
        here = np.arange(len(walk))
        place = k if order is None else order[here, k]
        np.minimum.at(sig, owner * places + place, (np.uint64(j) << _HIGH) | (draw & _LOW))
        going = (sig.reshape(n, places).max(axis=1) >> _HIGH > np.uint64(j))[owner]
        if not going.any():
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (int(going.sum()), 1))
            k = k[going]
            order[np.arange(len(k)), k] = 0
        else:
            order[here, k] = order[here, j]
            order = order if going.all() else order[going]
        walk, owner = walk[going], owner[going]
    return sig.reshape(n, places)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of size words of each text, or of all its words if they are fewer; sorted within a text."""
    out, ends = [], [0]
    h = words.hashes
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        run = min(size, b - a)
        if run:
            found = np.full(b - a - run + 1, run, np.uint64)
            for i in range(run):
                found = mix(found * GAMMA + h[a + i : b - run + 1 + i])
            out.append(np.unique(found))
        ends.append(ends[-1] + (len(out[-1]) if run else 0))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.asarray(ends)


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts = batch.column("doc_id"), text_list(batch)
            for first, raws in byte_chunks(texts, 1 << 18):
                sets, ends = shingles(Words(raws, SPACED), size)
                sig = superminhash(sets, ends, bands * rows).reshape(len(raws), bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(raws), bands))
                for i in range(rows):
                    key = mix(key * GAMMA + sig[:, :, i])
                digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(raws)), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.binary()), list_array(key.reshape(-1).view(np.int64), np.arange(len(raws) + 1) * bands, pa.int64())],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sketches(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(ends) - 1
    at = np.repeat(np.arange(n) * SKETCH_BITS, np.diff(ends)) + (sets & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts = batch.column("doc_id"), text_list(batch)
            for first, raws in byte_chunks(texts):
                sets, ends = shingles(Words(raws, SPACED), size)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(raws)), list_array(sets.view(np.int64), ends, pa.int64()), list_array(_sketches(sets, ends), np.arange(len(raws) + 1) * (SKETCH_BITS // 64), pa.int64())], ["doc_id", "shingles", "sketch"])

    return docs.mapInArrow(sets_of, "doc_id long, shingles array<long>, sketch array<long>")


def union_find(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node that it is linked with, over any number of links."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p] if p in parent else p
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["v", "m"])

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    edges = cut(links.mapInArrow(local, "v long, m long").distinct())
    nodes, seen = edges, state(edges.where("v != m"))
    edges = edges.where("v != m")
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v != m")
        down = large.distinct()
        low = down.groupBy("v").agg(F.min("m").alias("low"))
        small = down.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v != m").unionByName(low.select("v", F.col("low").alias("m")))
        edges = cut(small.distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
    return nodes.select(F.col("v").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _pairs_of_groups(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of rest (bucket, parts, doc_id, n, root, sketch) that share a bucket, are in different groups and may be alike by size and sketch.

    Sets that are alike are in the same size class or the next (classes grow by the similarity; one more allows for
    rounding). The row of the lower class is in one part of its bucket, that of the higher class in all parts.
    """
    size_class = F.floor(F.log("n") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    rows = rest.withColumn("class", size_class)
    side = lambda x, *more: rows.select("bucket", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("sketch").alias(f"k{x}"), F.col("class").alias(f"c{x}"), "parts", *more)
    low = side("a", F.explode(F.array(*[F.col("class") + i for i in range(3)])).alias("class")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    high = side("b", "class").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    bits = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    once = (F.col("ca") < F.col("cb")) | (F.col("a") < F.col("b"))
    near = once & (F.col("ra") != F.col("rb")) & fits & (bits * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    met = low.join(high, ["bucket", "class", "part"]).where(near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity_percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if 100 * |A & B| >= similarity_percent * |A | B| for their sets of shingles; component_id is
    the smallest doc_id reachable over links. Null, empty and blank texts have an empty set, no links and are kept.
    Rows are taken as distinct by doc_id: texts under one doc_id are one node, and each of their rows is returned. A null
    doc_id gets null for component_id, links nothing and is kept. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(_signed(texts, shingle_words, bands, rows))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    band_rows = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowded = band_rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    met = cut(band_rows.join(crowded, "bucket"))
    sizes = met.select("doc_id", "n").distinct()
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity_percent
    hubs = met.where("hub != doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("nb")).distinct()
    first = cut(hubs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").where(fits).select("a", "b"))
    sets = cut(_sets(texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), shingle_words))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
        return both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * similarity_percent).select("a", "b")

    links = cut(confirmed(first))
    roots = cut(union_find(links))
    grouped = met.join(roots, met["doc_id"] == roots["node"], "left").select("bucket", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = grouped.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("bucket", F.ceil(F.col("members") / SPLIT).cast("int").alias("parts"))
    rest = cut(grouped.join(mixed, "bucket").join(sets.select("doc_id", "sketch"), "doc_id"))
    second = _pairs_of_groups(rest, similarity_percent).join(first, ["a", "b"], "left_anti")
    more = cut(confirmed(cut(second)))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = cut(union_find(links))
    to = classes.join(roots, classes["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(to, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
