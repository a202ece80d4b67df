"""Summaries of social mentions: nested documents with source, content, metrics and theme arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MENTION = (
    "id string, author string, content_type string, sentiment string, published timestamp, url string, theme string, cause string, classification string, voc_takeaway string, why_notable string, viral_status string, top_comment string, top_comment_author string, top_comment_likes long, representative_quote string, "
    "source struct<source_type:string,name:string>, content struct<title:string,body:string>, metrics struct<engagement:long,reach:long,likes:long,comments:long,shares:long>, velocity_pct int, pi_flag boolean, positive_themes array<string>, improvement_themes array<string>"
)
#: Causes of a spike, and classes of paid mentions.
CAUSES = ["Creator Organic", "Press/Editorial", "Complaint Cluster", "Paid/Seeded", "Unknown"]
EXPLICIT, INFERRED = "INCENTIVIZED_EXPLICIT", "INCENTIVIZED_INFERRED"


def _said(col: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit(default))


def _number(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves to the even one; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole)), F.lit(0.0)).cast("int")


def _first(docs: DataFrame, n: int) -> DataFrame:
    """The n most engaging mentions, ties by id."""
    return docs.orderBy(F.desc_nulls_last("metrics.engagement"), "id").limit(n)


def mention_posts(docs: DataFrame, n: int = 50) -> DataFrame:
    """Flat posts of the n most engaging mentions, numbered in that order (so the numbering sees n rows)."""
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("metrics.engagement"), "id"))
    return _first(docs, n).select(
        "id", rank.alias("rank"), _said("source.source_type").alias("platform"), _said("content_type", "Post").alias("content_type"), _said("content.title").alias("headline"), _said("author").alias("author"), _said("source.name").alias("source"),
        F.date_format("published", "yyyy-MM-dd").alias("submission_date"), F.initcap(_said("sentiment")).alias("sentiment"), _number("metrics.reach").alias("views"), _number("metrics.likes").alias("likes"), _number("metrics.comments").alias("comments"), _number("metrics.shares").alias("shares"),
        _number("metrics.engagement").alias("engagement"), _number("velocity_pct").alias("velocity_pct"), _said("viral_status").alias("viral_status"), _said("theme").alias("theme"), _said("voc_takeaway").alias("voc_takeaway"), F.substring(_said("content.body"), 1, 220).alias("snippet"),
        _said("top_comment").alias("top_comment"), _said("top_comment_author").alias("top_comment_author"), _number("top_comment_likes").alias("top_comment_likes"), _said("classification", "ORGANIC").alias("classification"), _said("cause", "Unknown").alias("cause"), _said("url").alias("url"),
    )


def top_comments(docs: DataFrame, n: int = 50) -> DataFrame:
    """The posts of mention_posts by the likes of their top comment."""
    return mention_posts(docs, n).orderBy(F.desc("top_comment_likes"), F.desc("engagement"), "id")


def fetch_mentions(docs: DataFrame, as_of: str, days: int, sources: list[str] | None = None, sentiments: list[str] | None = None, sort: str = "engagement", limit: int = 50) -> DataFrame:
    """Mentions of the last days with these sources and sentiments; the most engaging, the widest or the newest first."""
    end = F.lit(as_of).cast("timestamp")
    rows = docs.where((F.col("published") >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("published") <= end))
    if sources:
        rows = rows.where(F.col("source.name").isin(sources))
    if sentiments:
        rows = rows.where(F.col("sentiment").isin(sentiments))
    key = {"engagement": "metrics.engagement", "reach": "metrics.reach"}.get(sort, "published")
    return rows.orderBy(F.desc_nulls_last(key), "id").limit(limit)


def spike_events(docs: DataFrame, n: int = 4) -> DataFrame:
    """The n fastest mentions, then the most engaging: date, title of 12 words, cause (of the known ones), engagement, reach, summary and flag."""
    top = docs.orderBy(F.desc_nulls_last("velocity_pct"), F.desc_nulls_last("metrics.engagement"), "id").limit(n)
    cause = F.when(F.col("cause").isin(CAUSES), F.col("cause")).otherwise("Unknown")
    title = F.array_join(F.slice(F.split(_said("content.title"), r"\s+"), 1, 12), " ")
    return top.select("id", F.date_format("published", "yyyy-MM-dd").alias("date"), title.alias("title"), cause.alias("cause"), _number("metrics.engagement").alias("engagement"), _number("metrics.reach").alias("reach"), _said("voc_takeaway").alias("summary"), F.coalesce("pi_flag", F.lit(False)).alias("pi_flag"), "velocity_pct")


def cause_breakdown(docs: DataFrame, n: int = 4) -> DataFrame:
    """Each known cause with its share of the spike events in percent, 0 where it has none."""
    facts = spike_events(docs, n).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("cause") == c).alias(f"c{i}") for i, c in enumerate(CAUSES)])
    rows = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"c{i}").alias("events"), percent(F.col(f"c{i}"), F.col("n")).alias("share_pct")) for i, c in enumerate(CAUSES)])
    return facts.select(F.explode(rows).alias("r")).select("r.*")


def paid_vs_organic(docs: DataFrame, n: int = 50) -> DataFrame:
    """One row over the n most engaging mentions: how many are organic or paid, explicitly or by inference, and whole average engagements."""
    kind = _said("classification", "ORGANIC")
    rows = _first(docs, n).select(kind.alias("kind"), _number("metrics.engagement").alias("engagement"))
    paid = F.col("kind").isin(EXPLICIT, INFERRED)
    average = lambda when: F.coalesce(F.bround(F.avg(F.when(when, F.col("engagement")))), F.lit(0.0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~paid).alias("organic"), F.count_if(F.col("kind") == EXPLICIT).alias("incentivized_explicit"), F.count_if(F.col("kind") == INFERRED).alias("incentivized_inferred"), average(~paid).alias("organic_avg_engagement"), average(paid).alias("incentivized_avg_engagement")
    )


def top_organic(docs: DataFrame, n: int = 3) -> DataFrame:
    """The n most engaging organic mentions of all."""
    rows = _first(docs.where(_said("classification", "ORGANIC") == "ORGANIC"), n)
    return rows.select("id", _said("url").alias("url"), F.array_join(F.slice(F.split(_said("content.title"), r"\s+"), 1, 10), " ").alias("title"), _number("metrics.engagement").alias("engagement"), F.coalesce(F.nullif(_said("why_notable"), F.lit("")), _said("voc_takeaway")).alias("why_notable"))


def theme_counts(docs: DataFrame, field: str, n: int) -> DataFrame:
    """The n most frequent themes of an array field, their share of all mentions in percent, and the quote of the most engaging mention: its top comment, else its quote, else its body. Ties by theme."""
    quote = F.substring(F.coalesce(*[F.nullif(_said(c), F.lit("")) for c in ("top_comment", "representative_quote", "content.body")], F.lit("")), 1, 160)
    rows = docs.select("id", quote.alias("quote"), F.explode(field).alias("theme"), _said("source.name").alias("source"), _number("metrics.engagement").alias("engagement"))
    best = F.max_by(F.struct("quote", "source", "engagement"), F.struct("engagement", "id"))
    by = rows.groupBy("theme").agg(F.count(F.lit(1)).alias("mentions"), best.alias("b")).orderBy(F.desc("mentions"), "theme").limit(n)
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return by.crossJoin(F.broadcast(total)).select("theme", "mentions", percent(F.col("mentions"), F.col("total")).alias("share_pct"), F.col("b.quote").alias("best_quote"), F.col("b.source").alias("quote_source"), F.col("b.engagement").alias("quote_engagement"))  # one row


def social_metrics(docs: DataFrame, n: int = 50) -> DataFrame:
    """One row over the n most engaging mentions: positive and organic shares in percent, the platform with the most engagement, and risk: High if a spike event is flagged."""
    posts = mention_posts(docs, n)
    top = posts.groupBy("platform").agg(F.sum("engagement").alias("engagement")).orderBy(F.desc("engagement"), "platform").limit(1)
    facts = posts.agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.lower("sentiment") == "positive").alias("positive"))
    events = spike_events(docs).agg(F.count(F.lit(1)).alias("viral_posts"), F.when(F.max("pi_flag"), "High").otherwise("Medium").alias("risk"))
    paid = paid_vs_organic(docs, n).select("organic", "total")
    rows = facts.crossJoin(events).crossJoin(paid).join(top, F.lit(True), "left")  # one row each
    return rows.select("mentions", percent(F.col("positive"), F.col("mentions")).alias("positive_pct"), "viral_posts", "risk", percent(F.col("organic"), F.greatest("total", F.lit(1))).alias("organic_share_pct"), F.coalesce("platform", F.lit("N/A")).alias("top_platform"))
