"""Summary measures and trends over reviews. Reviews have the columns of plans.reviews; rows without a time have no place in trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import region_label


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def share(hit: Column, of: Column | None = None) -> Column:
    """Share of rows (0 if there are none)."""
    return F.coalesce(F.try_divide(F.sum(F.when(hit, 1).otherwise(0)), of if of is not None else F.count(F.lit(1))), F.lit(0.0))


def compute_metrics(df: DataFrame) -> DataFrame:
    """One row of measures; low stars are ratings under 3."""
    low, organic = F.coalesce(F.col("rating") < 3, F.lit(False)), ~_flag("incentivized_review")
    return df.agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        F.avg(F.when(organic, F.col("rating"))).alias("avg_rating_non_incentivized"),
        share(low).alias("pct_low_star"),
        share(F.col("rating") == 1).alias("pct_one_star"),
        share(F.col("rating") == 2).alias("pct_two_star"),
        share(F.col("rating") == 5).alias("pct_five_star"),
        share(_flag("incentivized_review")).alias("pct_incentivized"),
        share(_flag("has_photos")).alias("pct_with_photos"),
        share(_flag("is_syndicated")).alias("pct_syndicated"),
        F.avg(F.col("is_recommended").cast("double")).alias("recommend_rate"),
        F.expr("percentile(review_length_words, 0.5)").alias("median_review_words"),
        F.coalesce(F.sum(organic.cast("long")), F.lit(0)).alias("non_incentivized_count"),
        F.coalesce(F.sum(low.cast("long")), F.lit(0)).alias("low_star_count"),
        F.count("rating").alias("rated_count"),
        F.count(F.when(organic, F.col("rating"))).alias("organic_rated_count"),
        F.coalesce(F.sum(_flag("incentivized_review").cast("long")), F.lit(0)).alias("incentivized_count"),
    )


def _stars(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))


def rating_distribution(df: DataFrame) -> DataFrame:
    """star, review_count and share of all rows for stars 1 to 5; ratings are rounded half to even and clipped."""
    star = F.least(F.greatest(F.bround("rating"), F.lit(1)), F.lit(5)).cast("int")
    by = df.groupBy(F.when(F.col("rating").isNotNull(), star).alias("star")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    kept = _stars(df).join(F.broadcast(by), "star", "left").crossJoin(F.broadcast(total))  # six rows and one
    return kept.select("star", F.coalesce("n", F.lit(0)).alias("review_count"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "total"), F.lit(0.0)).alias("share"))


def monthly_trend(df: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "submission_time").alias("month_start")
    return df.where("submission_time IS NOT NULL").groupBy(month).agg(F.count("review_id").alias("review_count"), F.avg("rating").alias("avg_rating"))


def cohort_by_incentivized(df: DataFrame) -> DataFrame:
    """Star counts (ratings cut to whole stars) and their share within the organic and the incentivised cohort; all ten rows."""
    rated = df.where("rating IS NOT NULL").select(_flag("incentivized_review").alias("incentivized"), F.col("rating").cast("int").alias("star"))
    by = rated.groupBy("incentivized", "star").agg(F.count(F.lit(1)).alias("n"))
    grid = _stars(df).withColumn("incentivized", F.explode(F.array(F.lit(False), F.lit(True))))
    totals = by.groupBy("incentivized").agg(F.sum("n").alias("total"))
    rows = grid.join(F.broadcast(by), ["incentivized", "star"], "left").join(F.broadcast(totals), "incentivized", "left")
    return rows.select("incentivized", "star", F.coalesce("n", F.lit(0)).alias("review_count"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), "total"), F.lit(0.0)).alias("share"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values with review_count, avg_rating and share of the kept rows; ties by value."""
    by = df.where(F.col(column).isNotNull() & (F.trim(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"))
    kept = by.orderBy(F.desc("review_count"), "value").limit(n)
    return kept.withColumn("share", F.col("review_count") / F.sum("review_count").over(Window.partitionBy()))  # n rows


def locale_breakdown(df: DataFrame, n: int = 12) -> DataFrame:
    return top_values(df, "content_locale", n)


def top_locations(df: DataFrame, n: int = 10) -> DataFrame:
    return top_values(df, "user_location", n).drop("share")


def review_length_cohort(df: DataFrame) -> DataFrame:
    """Measures by quartile of review length; no rows if there are fewer than 8 reviews or two edges coincide."""
    rows = df.where("review_length_words IS NOT NULL")
    edges = rows.agg(F.expr("percentile(review_length_words, array(0.0, 0.25, 0.5, 0.75, 1.0))").alias("e"), F.count(F.lit(1)).alias("n"))
    usable = edges.where((F.col("n") >= 8) & (F.size(F.array_distinct("e")) == 5))
    w, e = F.col("review_length_words"), F.col("e")
    cohort = F.when(w <= e[1], "Q1").when(w <= e[2], "Q2").when(w <= e[3], "Q3").otherwise("Q4")
    joined = rows.crossJoin(F.broadcast(usable)).select(cohort.alias("cohort"), "rating", "review_length_words")  # one row of edges
    return joined.groupBy("cohort").agg(F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"), F.expr("percentile(review_length_words, 0.5)").alias("median_words"))


def star_band_trend(df: DataFrame) -> DataFrame:
    """By month the numbers and shares of low (1 to 2) and high (4 to 5) ratings among rated reviews."""
    rated = df.where("submission_time IS NOT NULL AND rating IS NOT NULL")
    out = rated.groupBy(F.date_trunc("month", "submission_time").alias("month_start")).agg(
        F.count(F.lit(1)).alias("review_count"), F.count_if(F.col("rating").between(1, 2)).alias("low_count"), F.count_if(F.col("rating").between(4, 5)).alias("high_count")
    )
    return out.withColumns({"low_share": F.col("low_count") / F.col("review_count"), "high_share": F.col("high_count") / F.col("review_count")})


def cumulative_region_trend(df: DataFrame, top_n: int | None = 2, smoothing_days: int = 7, organic_only: bool = False, region_from: str = "content_locale") -> DataFrame:
    """(day, series, volume, cum_avg): the average of all ratings so far, for every day, overall and for the largest regions.

    Reviews are added up by day and region first; windows run over days. Unknown is a region only if it is the only one.
    """
    rows = df.where("submission_time IS NOT NULL AND rating IS NOT NULL")
    if organic_only:
        rows = rows.where(~_flag("incentivized_review"))
    daily = rows.groupBy(F.date_trunc("day", "submission_time").alias("day"), region_label(region_from).alias("region")).agg(F.count("review_id").alias("n"), F.sum("rating").alias("stars"))
    daily = daily.persist()  # a row for each day and region, read several times below
    totals = daily.groupBy("region").agg(F.sum("n").alias("total")).withColumn("known", (F.col("region") != "Unknown").cast("int"))
    ranked = totals.withColumn("best", F.max("known").over(Window.partitionBy())).where("known = best").orderBy(F.desc("total"), "region")
    regions = (ranked if top_n is None else ranked.limit(top_n)).select("region")
    parts = daily.join(F.broadcast(regions), "region").select("day", F.col("region").alias("series"), "n", "stars")
    overall = daily.groupBy("day").agg(F.sum("n").alias("n"), F.sum("stars").alias("stars")).select("day", F.lit("Overall").alias("series"), "n", "stars")
    counted = overall.unionByName(parts)
    days = daily.agg(F.explode(F.expr("sequence(min(day), max(day), interval 1 day)")).alias("day"))
    grid = days.crossJoin(F.broadcast(counted.select("series").distinct()))  # days by a few series
    full = grid.join(counted, ["day", "series"], "left")
    so_far = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = full.select("day", "series", F.coalesce("n", F.lit(0)).alias("volume"), F.try_divide(F.sum("stars").over(so_far), F.sum("n").over(so_far)).alias("cum_avg"))
    if smoothing_days > 1:
        out = out.withColumn("cum_avg", F.avg("cum_avg").over(Window.partitionBy("series").orderBy("day").rowsBetween(1 - smoothing_days, 0)))
    return out


def volume_series(trend: DataFrame, mode: str = "day") -> DataFrame:
    """(bucket_start, x, volume, width_ms, label) from (day, volume): bars of a day, a week from Monday, or a month."""
    start = F.date_trunc(mode, "day").alias("bucket_start")
    by = trend.where("day IS NOT NULL").groupBy(start).agg(F.sum("volume").alias("volume"))
    days = F.lit(7.0) if mode == "week" else F.day(F.last_day("bucket_start")).cast("double") if mode == "month" else F.lit(1.0)
    label = {"week": F.concat(F.lit("Week of "), F.date_format("bucket_start", "yyyy-MM-dd")), "month": F.date_format("bucket_start", "yyyy-MM")}.get(mode, F.date_format("bucket_start", "yyyy-MM-dd"))
    middle = F.timestamp_micros(F.unix_micros("bucket_start") + (days * 43_200_000_000).cast("long"))
    return by.select("bucket_start", middle.alias("x"), "volume", (F.greatest(days - 0.15, F.lit(0.35)) * 86_400_000).cast("long").alias("width_ms"), label.alias("label"))
