"""The table that is merged on read: against the batch upsert, after restarts, with tombstones, compaction and bytes in proportion."""

import random

import pytest
from pyspark.sql import functions as F

from tallyvox.operators.merge import upsert_reviews
from tallyvox.streaming import merge_table as M
from tallyvox.streaming import streams

SCHEMA = "review_id string, product_id string, n int"


def rows_of(df):
    return sorted((r["review_id"], r["product_id"], r["n"]) for r in df.collect())


@pytest.mark.parametrize("compact_at", [0.0, 0.5, 1e9])
def test_stream_equals_the_batch_upsert_after_restarts(spark, tmp_path, compact_at):
    rng = random.Random(3)
    land, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    want = spark.createDataFrame([], SCHEMA)
    for step in range(4):
        batch = [(f"r{rng.randint(0, 60)}", f"p{step}", step * 1000 + i) for i in range(40)]
        df = spark.createDataFrame([*batch, (None, "no key", 1)], SCHEMA).coalesce(1)
        df.write.mode("append").parquet(land)
        M.stream_upsert(streams.stream_reviews(spark, land, SCHEMA), out, ["n"], log, buckets=4, compact_at=compact_at).awaitTermination()
        want = spark.createDataFrame(upsert_reviews(want, df.where("review_id IS NOT NULL"), ["n"]).select("review_id", "product_id", "n").collect(), SCHEMA)
        assert rows_of(M.read_table(spark, out)) == rows_of(want)
    state = M.table_state(spark, out)
    if compact_at == 0:
        assert not state.pending()
    if compact_at == 1e9:  # a bucket's first rows become its base, and nothing is written anew after
        assert len(state.base) == 4 and state.pending()


def test_repeats_tombstones_and_new_columns(spark, tmp_path):
    out = str(tmp_path / "t")
    with pytest.raises(ValueError):
        M.read_table(spark, out)
    M.write_delta(spark.createDataFrame([("a", "p", 1), ("b", "p", 2), ("b", "p", 3), ("c", "p", None)], SCHEMA), out, 0, "review_id", ["n"], 4)
    M.compact(spark, out)
    gone = spark.createDataFrame([("a", True), ("z", True), ("c", False)], "review_id string, _deleted boolean")
    for _ in range(2):  # a batch that is written again
        M.write_delta(gone.withColumns({"n": F.lit(9), "product_id": F.lit("q"), "more": F.lit("new")}), out, 1, "review_id", ["n"], 4)
    assert sorted((r["review_id"], r["n"], r["more"]) for r in M.read_table(spark, out).collect()) == [("b", 3, None), ("c", 9, "new")]
    M.write_delta(spark.createDataFrame([("a", "back", 5)], SCHEMA), out, 2, "review_id", ["n"], 4)
    assert rows_of(M.read_table(spark, out)) == [("a", "back", 5), ("b", "p", 3), ("c", "q", 9)]
    assert M.compact(spark, out, at=0.0)
    assert rows_of(M.read_table(spark, out)) == [("a", "back", 5), ("b", "p", 3), ("c", "q", 9)]
    assert M.drop_superseded(spark, out, 2) >= 1 and rows_of(M.read_table(spark, out)) == [("a", "back", 5), ("b", "p", 3), ("c", "q", 9)]


def test_a_folder_that_is_not_complete_is_not_read(spark, tmp_path):
    out = str(tmp_path / "t")
    for seq in (0, 1):
        M.write_delta(spark.createDataFrame([("a", "p", seq)], SCHEMA), out, seq, "review_id", ["n"], 2)
    (tmp_path / "t/delta/seq=1/_SUCCESS").unlink()
    assert rows_of(M.read_table(spark, out)) == [("a", "p", 0)]


def test_bytes_of_a_batch_follow_the_batch(spark, tmp_path):
    """A small batch on a large table writes little; over many batches all that is written stays within a few times what came."""
    out = str(tmp_path / "t")
    big = spark.range(40_000).select(F.concat(F.lit("r"), "id").alias("review_id"), F.sha2(F.col("id").cast("string"), 256).alias("product_id"), F.col("id").cast("int").alias("n"))
    M.write_delta(big, out, 0, "review_id", ["n"], 8)
    M.compact(spark, out)
    base = sum(M.table_state(spark, out).base.values())
    came = 0
    for seq in range(1, 7):
        M.write_delta(big.where(F.col("n") % 997 == seq).withColumn("product_id", F.lit(f"x{seq}")), out, seq, "review_id", ["n"], 8)
        M.compact(spark, out)
        state = M.table_state(spark, out)
        came = sum(v for (s, _), v in state.delta.items() if s > 0)
        assert sum(v for (s, _), v in state.delta.items() if s == seq) < base / 20
    assert sum(state.base.values()) == base and came < base / 5
    assert M.read_table(spark, out).count() == 40_000
