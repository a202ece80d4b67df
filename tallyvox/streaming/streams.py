"""Review jobs over streams; after all input each gives what its batch operator gives on the union of the input."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.audit import alerts_of_counts, sides_long
from ..operators.products import enrich_with_catalog
from . import merge_table

#: A label tracker's tables are small: a row for each label and side.
TRACKER_BUCKETS = 4
#: Fixed windows by period; weeks start on Monday, the epoch's first day was a Thursday.
WINDOWS = {"D": ("1 day", "0 days"), "W": ("7 days", "4 days")}


def stream_reviews(spark: SparkSession, folder: str, schema: StructType | str, catalog: DataFrame | None = None, normalize: Callable[[DataFrame], DataFrame] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Reviews from Parquet files that land in a folder, normalised, and enriched by the static catalog; columns that older files lack are null."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    rows = normalize(rows) if normalize else rows
    return enrich_with_catalog(rows, catalog) if catalog is not None else rows


def stream_dedupe(rows: DataFrame, delay: str = "1 day", time_col: str = "submission_time", keys: list[str] | None = None) -> DataFrame:
    """The first arrival of each key; state is dropped once the watermark has passed it by delay."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys or ["review_id"])


def stream_trend(rows: DataFrame, cols: list[str], measures: list[Column], freq: str = "W", delay: str = "30 days", time_col: str = "submission_time") -> DataFrame:
    """Measures by group and period. Days and weeks are tumbling windows, whose state ends with the watermark; a month is no fixed window and is grouped by its first day, for update mode."""
    timed = rows.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    if freq == "M":
        return timed.groupBy(*cols, F.date_trunc("month", time_col).alias("period_start")).agg(*measures)
    size, start = WINDOWS[freq]
    by = timed.groupBy(*cols, F.window(time_col, size, startTime=start).alias("_w")).agg(*measures)
    return by.withColumn("period_start", F.col("_w.start")).drop("_w")


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run over all input that is there, in update mode; each batch adds its changed rows with its number to the table out."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/step={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_appends(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run over all input that is there, in append mode, to Parquet files below out."""
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of each key of a table of updates."""
    rows = spark.read.parquet(out).drop("step")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))
    return rows.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_batch")


def stream_label_counts(tags: DataFrame) -> DataFrame:
    """Running counts by side and label of a stream of tags, with rows for all reviews and those without any tag; for update or complete mode. State: one row for each label."""
    return sides_long(tags).groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))


def _alert_changes(now: DataFrame, then: DataFrame | None) -> DataFrame:
    """(alert, label, side, issue, pct, count, change): alerts that are new, say something else than before, or have ended."""
    facts = ["label", "side", "issue", "pct", "count"]
    now = now.select(F.to_json(F.struct("side", "label", "issue")).alias("alert"), *facts)
    if then is None:
        return now.withColumn("change", F.lit("new"))
    both = now.alias("n").join(then.alias("t"), "alert", "full_outer")
    change = F.when(F.col("t.label").isNull(), "new").when(F.col("n.label").isNull(), "ended").when((F.col("n.pct") != F.col("t.pct")) | (F.col("n.count") != F.col("t.count")), "changed")
    return both.select("alert", *[F.coalesce(f"n.{c}", f"t.{c}").alias(c) for c in facts], change.alias("change")).where("change IS NOT NULL")


def stream_label_tracker(tags: DataFrame, catalog: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Follow the label alerts over a stream of tags: each batch adds the alerts that it changed, with its number, to out/changes.

    The running counts come in update mode, so a batch brings the labels that it has met only; they go to a merged table
    (out/counts), as do the alerts that hold (out/alerts). A batch that is repeated after a failure looks at the tables
    as they were before it and writes the same.
    """

    def track(batch: DataFrame, batch_id: int) -> None:
        spark, counts, alerts = batch.sparkSession, f"{out}/counts", f"{out}/alerts"
        for table, key in ((counts, "key"), (alerts, "alert")):
            merge_table.compact(spark, table, key, before=batch_id)
        merge_table.write_delta(batch.withColumn("key", F.to_json(F.struct("side", "label"))), counts, batch_id, "key", ["n"], TRACKER_BUCKETS)
        now = alerts_of_counts(merge_table.read_table(spark, counts, "key").drop("key"), catalog)
        then = None if merge_table.is_empty(spark, alerts, batch_id) else merge_table.read_table(spark, alerts, "alert", batch_id)
        changes = _alert_changes(now, then)
        changes.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/changes/step={batch_id}")
        kept = spark.read.parquet(f"{out}/changes/step={batch_id}")
        merge_table.write_delta(kept.withColumn(merge_table.DELETED, F.col("change") == "ended").drop("batch", "change"), alerts, batch_id, "alert", ["issue"], TRACKER_BUCKETS)

    return stream_label_counts(tags).writeStream.outputMode("update").foreachBatch(track).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts that hold after the last batch of a label tracker."""
    return merge_table.read_table(spark, f"{out}/alerts", "alert").drop("alert")


def union_streams(streams: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
