"""Review-shaped rows from the given tables, in Spark and as a common table expression for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETRACTORS = ["loud", "hard to clean", "wrong size", "too loud", "Not Mentioned", "overall dissatisfaction"]
DELIGHTERS = ["quiet", "easy to clean", "fast charging", "overall satisfaction", "<none>", "good value"]
CODES = ["US", "GB", "CA", "FR", "ZZ", "DE"]
DET_COLS, DEL_COLS = ["AI Symptom Detractor 1", "AI Symptom Detractor 2"], ["AI Symptom Delighter 1", "AI Symptom Delighter 2"]
FALLING, RISING, SINCE = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"], ["Brand#21", "Brand#22", "Brand#23", "Brand#24", "Brand#25"], "2001-09-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: how many rows a task holds at most, about, where it must hold them all.
TASK_ROWS = 250_000


def parts_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Into how many parts rows like those of a table are dealt, so that a task's part does not grow with the table. The number of rows comes from the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def _pick(values: list[str], index: Column) -> Column:
    return reduce(lambda acc, x: acc.when(index == x[0], x[1]), list(enumerate(values))[1:], F.when(index == 0, values[0]))


def reviews(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """A review for each line item; the dimension tables join on their keys and Spark picks the strategy by size.

    Customers and nations meet the orders, of which there are fewer, so that line items move twice and not three times.
    parts: into how many tasks the line items are dealt to meet their orders, if not the session's number.
    """
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer", "nation")}
    ordered = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    rows = (lines if parts is None else lines.repartition(parts, "l_orderkey")).join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.col(c).cast("string")
    late = F.col("l_shipdate") >= F.lit(SINCE).cast("timestamp")
    shift = F.when(late & F.col("p_brand").isin(FALLING), -1).when(late & F.col("p_brand").isin(RISING), 1).otherwise(0)
    stars = F.greatest(F.least(1 + F.col("l_quantity") % 5 + shift, F.lit(5.0)), F.lit(1.0))
    body = F.concat_ws(" ", "p_name", F.lower("p_type"), "o_orderpriority", "o_orderstatus")
    odd = F.col("l_linenumber") % 2 == 1
    return rows.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("review_id"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("order_line"),
        text("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 3 == 0, text("l_suppkey")).alias("base_sku"), F.lit("").alias("sku_item"), F.col("p_name").alias("original_product_name"),
        F.col("p_name").alias("base_model_number"), F.col("p_brand").alias("mapped_brand"), F.col("p_type").alias("mapped_category"), F.lit(None).cast("string").alias("mapped_subcategory"), F.lit(None).cast("string").alias("master_item"),
        F.when(F.col("n_nationkey") != 7, F.col("n_name")).alias("country"), F.concat(F.lit("en_"), _pick(CODES, F.col("n_nationkey") % 6)).alias("content_locale"), F.col("n_name").alias("user_location"), F.col("c_mktsegment").alias("retailer"),
        F.col("l_shipdate").alias("submission_time"), F.when(F.round(F.col("l_tax"), 2) != 0.08, stars).alias("rating"),
        (F.col("l_returnflag") == "R").alias("incentivized_review"), F.when(F.col("l_returnflag") != "A", F.col("l_linestatus") == "F").alias("is_recommended"), (F.col("l_linenumber") % 2 == 1).alias("has_photos"), (F.col("l_suppkey") % 11 == 0).alias("is_syndicated"),
        F.when(F.col("l_suppkey") % 13 == 0, "BVSampling_2").when(F.col("l_suppkey") % 7 == 0, "whol_x").when(F.col("l_suppkey") % 5 == 0, "bv_pie_mpr").alias("campaign_id"),
        F.when(F.col("l_discount") > 0.08, "pending").when(F.col("l_discount") > 0.06, "Rejected").when(F.col("l_discount") > 0.02, "approved").alias("moderation_status"),
        F.col("o_orderpriority").alias("title"), body.alias("review_text"), F.concat_ws(" ", "o_orderpriority", body).alias("title_and_text"), (F.size(F.split(body, r"\s+")) + (F.col("l_partkey") % 40).cast("int")).alias("review_length_words"), F.length(body).alias("review_length_chars"),
        F.when(odd, _pick(DETRACTORS, F.col("l_partkey") % 6)).alias(DET_COLS[0]), _pick(DETRACTORS, F.col("l_suppkey") % 6).alias(DET_COLS[1]),
        F.when(odd, _pick(DELIGHTERS, F.col("l_partkey") % 6)).alias(DEL_COLS[0]), _pick(DELIGHTERS, F.col("l_suppkey") % 6).alias(DEL_COLS[1]),
    )


def _case(values: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_BRANDS = lambda xs: ", ".join(f"'{x}'" for x in xs)
REVIEWS_SQL = f"""
reviews AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id, concat_ws('-', l_orderkey, l_linenumber) AS order_line,
p_partkey::VARCHAR AS product_id, CASE WHEN p_partkey % 3 = 0 THEN l_suppkey::VARCHAR END AS base_sku, '' AS sku_item, p_name AS original_product_name, p_name AS base_model_number, p_brand AS mapped_brand, p_type AS mapped_category, NULL::VARCHAR AS mapped_subcategory, NULL::VARCHAR AS master_item,
CASE WHEN n_nationkey <> 7 THEN n_name END AS country, 'en_' || {_case(CODES, 'n_nationkey % 6')} AS content_locale, n_name AS user_location, c_mktsegment AS retailer, l_shipdate AS submission_time,
CASE WHEN round(l_tax, 2) <> 0.08 THEN greatest(least(1 + l_quantity % 5 + CASE WHEN l_shipdate >= TIMESTAMP '{SINCE}' AND p_brand IN ({_BRANDS(FALLING)}) THEN -1 WHEN l_shipdate >= TIMESTAMP '{SINCE}' AND p_brand IN ({_BRANDS(RISING)}) THEN 1 ELSE 0 END, 5.0), 1.0) END AS rating,
l_returnflag = 'R' AS incentivized_review, CASE WHEN l_returnflag <> 'A' THEN l_linestatus = 'F' END AS is_recommended, l_linenumber % 2 = 1 AS has_photos, l_suppkey % 11 = 0 AS is_syndicated,
CASE WHEN l_suppkey % 13 = 0 THEN 'BVSampling_2' WHEN l_suppkey % 7 = 0 THEN 'whol_x' WHEN l_suppkey % 5 = 0 THEN 'bv_pie_mpr' END AS campaign_id,
CASE WHEN l_discount > 0.08 THEN 'pending' WHEN l_discount > 0.06 THEN 'Rejected' WHEN l_discount > 0.02 THEN 'approved' END AS moderation_status,
o_orderpriority AS title, concat_ws(' ', p_name, lower(p_type), o_orderpriority, o_orderstatus) AS review_text, concat_ws(' ', o_orderpriority, p_name, lower(p_type), o_orderpriority, o_orderstatus) AS title_and_text,
len(string_split_regex(concat_ws(' ', p_name, lower(p_type), o_orderpriority, o_orderstatus), '\\s+')) + l_partkey % 40 AS review_length_words, length(concat_ws(' ', p_name, lower(p_type), o_orderpriority, o_orderstatus)) AS review_length_chars,
CASE WHEN l_linenumber % 2 = 1 THEN {_case(DETRACTORS, 'l_partkey % 6')} END AS det1, {_case(DETRACTORS, 'l_suppkey % 6')} AS det2, CASE WHEN l_linenumber % 2 = 1 THEN {_case(DELIGHTERS, 'l_partkey % 6')} END AS del1, {_case(DELIGHTERS, 'l_suppkey % 6')} AS del2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
prepared AS (SELECT *, coalesce(rating <= 2, false) AS low_star, NOT incentivized_review AS organic_flag FROM reviews)
"""


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each document, rated by its labels where there are some."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stars = F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 0, 2.0).when(F.col("quality") == 1, 5.0)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_text"), F.col("text").alias("title_and_text"), F.col("lang").alias("content_locale"), F.col("source").alias("retailer"), stars.alias("rating"), (F.col("doc_id") % 4 == 0).alias("incentivized_review"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id") * 3600).alias("submission_time"), F.size(F.split(F.trim("text"), " ")).alias("review_length_words"),
    )


TEXTS_SQL = """
texts AS (SELECT doc_id::VARCHAR AS review_id, text AS review_text, text AS title_and_text, lang AS content_locale, source AS retailer, CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 0 THEN 2.0 WHEN quality = 1 THEN 5.0 END::DOUBLE AS rating, doc_id % 4 = 0 AS incentivized_review,
make_timestamp((1600000000 + doc_id * 3600) * 1000000) AS submission_time, len(string_split(trim(text, ' '), ' ')) AS review_length_words FROM documents LEFT JOIN labels USING (doc_id))
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each event: the type is its platform, the value its engagement."""
    e = table(spark, sf_dir, "events")
    n = lambda c: F.floor(F.coalesce(F.col("value"), F.lit(0.0)) * c).cast("long")
    kind = F.col("event_id") % 3
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("author"), F.lit("post").alias("content_type"), F.when(kind == 0, "positive").when(kind == 1, "negative").otherwise("neutral").alias("sentiment"), F.col("ts").alias("published"), F.lit("").alias("url"), F.lit("").alias("theme"),
        _pick(["Creator Organic", "Press/Editorial", "Complaint Cluster", "Weather"], F.col("user_id") % 4).alias("cause"), _pick(["ORGANIC", "INCENTIVIZED_EXPLICIT", "", "INCENTIVIZED_INFERRED"], F.col("event_id") % 4).alias("classification"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("voc_takeaway", "string"), ("why_notable", "string"), ("viral_status", "string"), ("top_comment", "string"), ("top_comment_author", "string"), ("top_comment_likes", "long"), ("representative_quote", "string"))], F.struct(F.lit("social").alias("source_type"), F.col("event_type").alias("name")).alias("source"), F.struct(F.col("event_type").alias("title"), F.coalesce("props", F.lit("")).alias("body")).alias("content"),
        F.struct(n(100).alias("engagement"), n(10).alias("reach"), n(1).alias("likes"), n(2).alias("comments"), n(3).alias("shares")).alias("metrics"), (F.col("event_id") % 97).cast("int").alias("velocity_pct"), (F.col("user_id") % 4 == 0).alias("pi_flag"),
        F.array(F.concat(F.lit("t"), (F.col("user_id") % 9).cast("string")), F.concat(F.lit("u"), (F.col("event_id") % 4).cast("string"))).alias("positive_themes"), F.array(F.concat(F.lit("i"), (F.col("event_id") % 12).cast("string"))).alias("improvement_themes"),
    )


MENTIONS_SQL = """
mentions AS (SELECT event_id::VARCHAR AS id, CASE event_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment, ts AS published, CASE user_id % 4 WHEN 0 THEN 'Creator Organic' WHEN 1 THEN 'Press/Editorial' WHEN 2 THEN 'Complaint Cluster' ELSE 'Weather' END AS cause, CASE event_id % 4 WHEN 1 THEN 'INCENTIVIZED_EXPLICIT' WHEN 3 THEN 'INCENTIVIZED_INFERRED' ELSE 'ORGANIC' END AS classification, user_id::VARCHAR AS author, event_type AS platform, coalesce(props, '') AS body, floor(coalesce(value, 0) * 100)::BIGINT AS engagement, floor(coalesce(value, 0) * 10)::BIGINT AS reach,
event_id % 97 AS velocity_pct, user_id % 4 = 0 AS pi_flag, ['t' || (user_id % 9), 'u' || (event_id % 4)] AS positive_themes, ['i' || (event_id % 12)] AS improvement_themes FROM events)
"""
