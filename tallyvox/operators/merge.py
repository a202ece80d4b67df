"""Unions, upserts and tag set algebra."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import blank_to_null, clean
from .products import keep_first


def upsert_reviews(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """stored with incoming rows in place of those with their review_id; of several incoming rows the last in order."""
    last = keep_first(incoming, ["review_id"], [F.desc(c) for c in order])
    return stored.join(last.select("review_id"), "review_id", "left_anti").unionByName(last, allowMissingColumns=True)


def loaded_from(df: DataFrame, index: int, url: str, label: str = "") -> DataFrame:
    """df with where it came from: url, host without www, label (the url if blank) and batch (the index, from 1)."""
    host = re.sub(r"^www\.", "", urlsplit(url).netloc.lower()) or "Unknown"
    return df.withColumns({"loaded_from_url": F.lit(url), "loaded_from_host": F.lit(host), "loaded_from_label": F.lit(label.strip() or url), "loaded_from_batch": F.lit(f"Link {index}")})


def merge_sources(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows, the first of each (review_id, product_id, text), trimmed; ids that still repeat get (2), (3) and so on.

    A blank id becomes review_ and 16 digits of a hash of product and text, which are unique by then, so that blank ids
    do not meet in one partition. Whole texts are compared by a hash of them, so that long texts do not travel as keys.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    text_hash = F.sha2(clean("review_text"), 256)
    blank = F.concat(F.lit("review_"), F.substring(F.sha1(F.concat_ws("|", clean("product_id"), text_hash)), 1, 16))
    rows = rows.withColumns({"_hash": text_hash, "_product": clean("product_id"), "review_id": F.coalesce(blank_to_null("review_id"), blank)})
    rows = keep_first(rows, ["review_id", "_product", "_hash"], ["_source", *order]).drop("_hash", "_product")
    n = F.row_number().over(Window.partitionBy("review_id").orderBy("_source", *order))
    return rows.withColumn("_n", n).withColumn("review_id", F.when(F.col("_n") > 1, F.concat("review_id", F.lit(" ("), "_n", F.lit(")"))).otherwise(F.col("review_id"))).drop("_n", "_source")


def merge_uploads(files: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of the files, the first of each review_id."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_source", F.lit(i)) for i, s in enumerate(files)])
    return keep_first(rows, ["review_id"], ["_source", *order]).drop("_source")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def merge_followup_tags(base: DataFrame, retry: DataFrame) -> DataFrame:
    """A retry fills sides that are empty in base; it never takes labels away. Columns: key, dets, dels, and what was added."""
    again = retry.select("key", F.col("dets").alias("dets2"), F.col("dels").alias("dels2"))
    out = base.join(again, "key", "left")
    side = lambda a, b: F.when(F.size(_list(a)) == 0, _list(b)).otherwise(_list(a))
    return out.select("key", side("dets", "dets2").alias("dets"), side("dels", "dels2").alias("dels"), F.array_except(side("dets", "dets2"), _list("dets")).alias("added_dets"), F.array_except(side("dels", "dels2"), _list("dels")).alias("added_dels"))


def merge_passes(a: DataFrame, b: DataFrame, keep: int = 3) -> DataFrame:
    """The ordered union of labels of two passes, and for each label its longest evidence texts, keep at most. Columns: key, tags, evidence."""
    two = b.select("key", F.col("tags").alias("tags2"), F.col("evidence").alias("evidence2"))
    empty = F.create_map().cast("map<string,array<string>>")
    both = a.join(two, "key", "full_outer")
    longest = lambda k, x, y: F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))), lambda p, q: F.when(F.length(p) != F.length(q), F.length(q) - F.length(p)).when(p < q, -1).when(p > q, 1).otherwise(0)), 1, keep)
    return both.select("key", F.array_union(_list("tags"), _list("tags2")).alias("tags"), F.map_zip_with(F.coalesce("evidence", empty), F.coalesce("evidence2", empty), longest).alias("evidence"))
