"""Registered queries over tag reports and streams, each with SQL for the same result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.symptoms import symptom_array
from ..streaming import streams
from .catalog import _LAB, _R, Query, six
from .reviews import DEL_COLS, DET_COLS, parts_of, reviews, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_UNUSED = "Never Seen"
_DETS, _DELS = ["Loud", "Hard To Clean", "Wrong Size", "Overall Dissatisfaction", _UNUSED], ["Quiet", "Easy To Clean", "Fast Charging", "Good Value", _UNUSED]


def query(name: str, sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: six(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return add


def tags(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Tags from the slots of the reviews; those with a photo have their text as evidence of each label. more: further columns of the reviews."""
    rows = reviews(spark, sf).select(F.col("review_id").alias("key"), "rating", "has_photos", "review_text", *more, symptom_array(DET_COLS).alias("dets"), symptom_array(DEL_COLS).alias("dels"))
    proof = lambda c: F.when(F.col("has_photos"), F.map_from_entries(F.transform(c, lambda x: F.struct(x, F.array("review_text")))))
    return rows.withColumns({"ev_det": proof("dets"), "ev_del": proof("dels")})


def counted_tags(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Tags for reports that only count reviews: a row for all reviews (n of them) whose slots, photo and columns of more say the same, so that wordings are worked out once for each such row. A photo counts as evidence of each label, whatever the text."""
    by = [*DET_COLS, *DEL_COLS, "has_photos", *more]
    rows = reviews(spark, sf).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("has_photos", *more, "n", symptom_array(DET_COLS).alias("dets"), symptom_array(DEL_COLS).alias("dels"))
    proof = lambda c: F.when(F.col("has_photos"), F.map_from_entries(F.transform(c, lambda x: F.struct(x, F.array().cast("array<string>")))))
    return rows.withColumns({"ev_det": proof("dets"), "ev_del": proof("dels")})


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, "detractor") for x in _DETS] + [(x, "delighter") for x in _DELS], "label string, side string")


_ARR = lambda side: f"list_distinct(list_filter([{_LAB(side + '1')}, {_LAB(side + '2')}], lambda x: x IS NOT NULL))"
_TAGS = _R + f""", tags AS (SELECT review_id AS key, rating, has_photos, {_ARR('det')} AS dets, {_ARR('del')} AS dels FROM reviews),
tl AS (SELECT key, has_photos, 'detractor' AS side, unnest(dets) AS label FROM tags UNION ALL SELECT key, has_photos, 'delighter', unnest(dels) FROM tags), n AS (SELECT count(*) AS total FROM tags),
labels AS (SELECT unnest({_DETS}) AS label, 'detractor' AS side UNION ALL SELECT unnest({_DELS}), 'delighter'), hits AS (SELECT side, label, count(*) AS c FROM tl GROUP BY 1, 2) """


@query("a20_regions", _R + "SELECT region, count(*) AS reviews FROM (SELECT unnest(list_distinct([CASE right(content_locale, 2) WHEN 'CA' THEN 'Canada' WHEN 'FR' THEN 'France' WHEN 'US' THEN 'USA' WHEN 'GB' THEN 'UK' WHEN 'DE' THEN 'Germany' ELSE right(content_locale, 2) END, CASE WHEN is_syndicated THEN 'UK' ELSE 'ZZ' END])) AS region FROM reviews) GROUP BY 1")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf).withColumn("other", F.when(F.col("is_syndicated"), "en-gb").otherwise("zz"))
    return audit.region_stats(rows, ["content_locale", "other"])


@query("a21_tag_distribution", _TAGS + "SELECT side, label, count(*) AS mentions, count(*) FILTER (NOT has_photos) AS without_evidence, round_even(count(*) / total * 100, 1) AS pct, count(*) < 2 AS singleton, count(*) > total * 0.5 AS dominant FROM tl, n GROUP BY side, label, total")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tag_distribution(counted_tags(spark, sf))


@query("a21_polarity", _TAGS + ", q AS (SELECT key, rating, CASE WHEN key LIKE '%2' THEN [] ELSE dets END AS dets, CASE WHEN key LIKE '%1' THEN [] ELSE dels END AS dels FROM tags), p AS (SELECT key, rating, CASE WHEN rating >= 5 AND len(dets) > 0 AND len(dels) = 0 THEN '5star_only_detractors' WHEN rating <= 2 AND len(dels) > 0 AND len(dets) = 0 THEN 'low_star_only_delighters' END AS issue FROM q) SELECT * FROM p WHERE issue IS NOT NULL")
def a21b(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = tags(spark, sf).withColumns({"dels": F.when(F.col("key").like("%1"), none).otherwise(F.col("dels")), "dets": F.when(F.col("key").like("%2"), none).otherwise(F.col("dets"))})
    return audit.polarity_mismatches(rows.drop("rating"), rows).select("key", "rating", "issue")


@query("a21_shared_evidence", _R.rstrip() + f""", e AS (SELECT DISTINCT substring(lower(trim(review_text)), 1, 60) AS evidence, unnest(list_concat({_ARR('det')}, {_ARR('del')})) AS label FROM reviews WHERE has_photos)
SELECT evidence, count(*)::INT AS labels FROM e WHERE length(evidence) >= 10 GROUP BY 1 HAVING count(*) >= 3""")
def a21c(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews without a photo have no evidence, so their labels need not be worked out."""
    return audit.shared_evidence(tags(spark, sf).where("has_photos")).withColumn("labels", F.size("labels"))


@query("a22_label_alerts", _TAGS + """SELECT label, side, issue, pct, count FROM (SELECT label, side, CASE WHEN coalesce(c, 0) / total > 0.45 THEN 'too_broad' WHEN coalesce(c, 0) = 0 AND total >= 20 THEN 'zero_hits' END AS issue, round_even(coalesce(c, 0) / total * 100, 1) AS pct, coalesce(c, 0) AS count FROM labels LEFT JOIN hits USING (label, side), n WHERE total >= 15) WHERE issue IS NOT NULL
UNION ALL SELECT '(overall)', 'both', 'high_zero_rate', round_even(u / total * 100, 1), u FROM (SELECT count(*) FILTER (len(dets) + len(dels) = 0) AS u, count(*) AS total FROM tags) WHERE total >= 15 AND u / total > 0.5""")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    return audit.label_alerts(counted_tags(spark, sf), labels(spark))


@query("a23_recommendations", _TAGS + """SELECT 'remove' AS action, side, label, 0::BIGINT AS count, 'medium' AS priority FROM labels ANTI JOIN hits USING (side, label), n WHERE total >= 15 UNION ALL SELECT 'split', side, label, c, 'high' FROM hits, n WHERE c > total * 0.4
UNION ALL SELECT 'promote', 'detractor', f, k, CASE WHEN k >= total * 0.1 THEN 'high' ELSE 'medium' END FROM (SELECT title AS f, count(*) AS k FROM reviews GROUP BY 1), n WHERE f <> '' AND k >= greatest(3, total * 0.05)""")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    rows = counted_tags(spark, sf, "title").withColumn("unl_dets", F.array("title"))
    return audit.taxonomy_recommendations(rows.withColumn("unl_dels", F.array().cast("array<string>")), labels(spark))


@query("a25_calibration", _TAGS + """SELECT *, CASE WHEN hit_rate >= 0.6 AND avg_tags >= 1.5 THEN 'ready' WHEN hit_rate >= 0.3 THEN 'needs_tuning' ELSE 'review_taxonomy' END AS recommendation FROM
(SELECT count(*) AS reviews, round(avg((len(dets) + len(dels) > 0)::INT), 6) AS hit_rate, round(avg(len(dets) + len(dels)), 6) AS avg_tags FROM tags), (SELECT count(*) AS unused_labels FROM labels ANTI JOIN hits USING (label, side))""")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return audit.calibration_report(counted_tags(spark, sf), labels(spark))


@query("a31_candidates", _TAGS + """, u AS (SELECT DISTINCT key, side, label FROM tl), k AS (SELECT label, side, count(*) AS count FROM u GROUP BY 1, 2)
SELECT side, label, count, coalesce((SELECT count FROM k o WHERE o.label = k.label AND o.side <> k.side), 0) AS other_side, (SELECT min(key) FROM u WHERE u.label = k.label AND u.side = k.side) AS first_key FROM k""")
def a31(spark: SparkSession, sf: str) -> DataFrame:
    """Labels are taken without their evidence, so that no texts move, by tasks whose share does not grow with the tables."""
    parts = parts_of(spark, sf, "lineitem")
    rows = reviews(spark, sf, parts).select(F.col("review_id").alias("key"), symptom_array(DET_COLS).alias("dets"), symptom_array(DEL_COLS).alias("dels"))
    return audit.candidate_labels(audit.key_labels(rows), parts=parts).withColumn("first_key", F.col("keys")[0]).drop("keys")


@query("x12_verification", _TAGS + """, w AS (SELECT t.*, len(string_split_regex(trim(review_text), '\\s+')) AS words FROM tags t JOIN reviews r ON r.review_id = t.key)
SELECT key, ((len(dets) + len(dels) = 0 AND words > 50) OR (NOT has_photos AND len(dets) + len(dels) >= 2) OR coalesce((rating >= 4.8 AND len(dets) > 0 AND len(dels) = 0) OR (rating <= 1.2 AND len(dels) > 0 AND len(dets) = 0), false)) AS needs_verification FROM w""")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    rows = tags(spark, sf)
    return audit.flag_for_verification(rows.drop("rating", "review_text"), rows).select("key", "needs_verification")


@query("x18_batches", "SELECT doc_id::VARCHAR AS review_id, greatest(ceil(length(coalesce(text, '')) / 3.5), 1)::BIGINT AS tokens, CASE WHEN length(text) > 600 THEN 'long' ELSE 'short' END AS route, least(greatest(floor(4000 / greatest(ceil(length(coalesce(text, '')) / 3.5), 1)), 2), 10)::BIGINT AS batch_size FROM documents")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    return audit.plan_batches(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_text")))


def _work(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; only a session whose tasks run in the driver's process may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-streams-')}/streams-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # as a pattern it may be a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


for _freq, _unit in (("W", "week"), ("M", "month")):

    @query(f"s4_stream_trend_{_unit}", f"SELECT event_type, date_trunc('{_unit}', ts)::TIMESTAMP AS period_start, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
    def s4(spark: SparkSession, sf: str, freq: str = _freq) -> DataFrame:
        folder = _work(spark)
        trend = streams.stream_trend(_events(spark, sf), ["event_type"], [F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value")], freq, time_col="ts")
        streams.run_updates(trend, f"{folder}/out", f"{folder}/log")
        return streams.latest(spark, f"{folder}/out", ["event_type", "period_start"])


@query("s3_stream_dedupe", "SELECT DISTINCT user_id FROM events")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    folder = _work(spark)
    once = streams.stream_dedupe(_events(spark, sf), "3650 days", "ts", ["user_id"]).select("user_id")
    streams.run_updates(once, f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").select("user_id")
