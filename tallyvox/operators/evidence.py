"""Label packs and their support in reviews, catalog pruning, evidence for a question, and the retailer watch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import region_label
from ..functions.phrases import phrases_said
from .rank import select_relevant
from .symptoms import symptom_array

#: What a taxonomy table calls its sides.
POSITIVE_SIDE = ["delighter", "delighters", "positive", "pos", "pros"]
NEGATIVE_SIDE = ["detractor", "detractors", "negative", "neg", "cons"]
#: Regions that go by a short name.
SHORT = {"UNITEDSTATES": "USA", "UNITEDSTATESOFAMERICA": "USA", "UNITEDKINGDOM": "UK", "GREATBRITAIN": "UK"}
#: What marks a review as not organic.
SEEDED = ["true", "1", "yes", "y", "seeded", "sponsored", "incentivized"]


def canon(col: Column | str) -> Column:
    """Lower case, straight quotes and hyphens, single spaces; null becomes empty."""
    text = F.lower(F.trim(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))))
    text = F.regexp_replace(F.translate(text, "’`‘“”", "'''\"\""), "[‐-―]", "-")
    return F.regexp_replace(text, r"\s+", " ")


def _phrases(label: str, aliases: list[str]) -> list[str]:
    return [p for p in dict.fromkeys(" ".join(x.lower().split()) for x in (label, *(aliases or []))) if p]


def supported_pack(reviews: DataFrame, pack: list[tuple[str, str, list[str]]], min_hits: int = 1, max_per_side: int = 6) -> DataFrame:
    """Of a pack's (label, side, aliases), the first max_per_side of each side that at least min_hits reviews contain, with hits.

    All phrases are looked for in one pass over a text, whatever their number; a review counts once for a label.
    """
    phrases = [(i, p) for i, (label, _, aliases) in enumerate(pack) for p in _phrases(label, aliases)]
    number = F.array(*[F.lit(i) for i, _ in phrases]).cast("array<int>")
    met = F.array_distinct(F.transform(phrases_said(canon("review_text"), [p for _, p in phrases]), lambda at: F.get(number, at)))
    hits = reviews.select(F.explode(met).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("hits"))
    labels = reviews.sparkSession.createDataFrame([(i, label, side) for i, (label, side, _) in enumerate(pack)], "position int, label string, side string")
    kept = labels.join(hits, "position").where(F.col("hits") >= max(min_hits, 1))
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy("side").orderBy("position"))).where(F.col("_rn") <= max_per_side).drop("_rn")


def prune_catalog(catalog: DataFrame, counts: DataFrame, min_reviews: int = 30, max_labels: int = 25) -> DataFrame:
    """Mark each label of a catalog (label, position) as primary or extended by its count in the past (label, n).

    With under min_reviews for each label on average the catalog's own order decides; else the most frequent labels
    come first and labels without a hit are extended. A catalog is small, so windows over all its rows do.
    """
    rows = catalog.select("label", "position").join(counts.select("label", "n"), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy()
    known = (F.bround(F.sum("n").over(every) / F.count(F.lit(1)).over(every)) >= min_reviews) & (F.max("n").over(every) > 0)
    ranked = rows.withColumn("known", known).withColumn("place", F.row_number().over(every.orderBy(F.when(F.col("known"), -F.col("n")), "position")))
    primary = (F.col("place") <= max_labels) & (~F.col("known") | (F.col("n") > 0))
    return ranked.select("label", "n", "place", F.when(primary, "primary").otherwise("extended").alias("tier"))


def load_taxonomy(df: DataFrame, det_cols: list[str] | None = None, del_cols: list[str] | None = None) -> DataFrame:
    """(side, label, aliases) from a table with a label and a side column, or else from the labels in the review slots.

    Sides are words such as pros or negative; aliases are cut at commas and bars. Rows without label or side go.
    """
    names = {c.strip().lower(): c for c in reversed(df.columns)}
    pick = lambda *wanted: next((F.trim(F.col(f"`{names[w]}`").cast("string")) for w in wanted if w in names), None)
    label, kind, alias = pick("symptom", "label", "name", "item"), pick("type", "polarity", "category", "side"), pick("aliases", "alias")
    if label is None or kind is None:
        slot = lambda cols, side: df.select(F.explode(symptom_array(cols)).alias("label")).select(F.lit(side).alias("side"), "label")
        parts = [slot(cols, side) for cols, side in ((det_cols, "detractor"), (del_cols, "delighter")) if cols]
        return reduce(DataFrame.unionByName, parts).distinct().withColumn("aliases", F.array().cast("array<string>"))
    side = F.when(F.lower(kind).isin(POSITIVE_SIDE), "delighter").when(F.lower(kind).isin(NEGATIVE_SIDE), "detractor")
    parts = F.filter(F.transform(F.split(F.coalesce(alias if alias is not None else F.lit(""), F.lit("")), "[,|]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.select(side.alias("side"), label.alias("label"), parts.alias("aliases")).where("side IS NOT NULL AND label != ''")
    return rows.groupBy("side", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))


def evidence_pack(df: DataFrame, question: str, size: int = 32) -> DataFrame:
    """At most size reviews for a question: the 22 most relevant, the 10 newest, 8 of low and 8 of high rating, each once; texts cut for display."""
    recent = [F.desc_nulls_last("submission_time"), F.col("review_id")]
    newest = df.orderBy(*recent)
    parts = [select_relevant(df, question).drop("score"), newest.limit(10), newest.where("rating IN (1, 2)").limit(8), newest.where("rating IN (4, 5)").limit(8)]
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])  # 48 rows at most
    once = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("review_id").orderBy("part"))).where("_rn = 1").drop("_rn")
    return once.orderBy("part", *recent).limit(size).withColumn("snippet", F.substring("review_text", 1, 600))


def watch_region(col: str) -> Column:
    """The region of a locale, a country code or a country's name."""
    code = region_label(col)
    named = reduce(lambda a, x: a.when(code == x[0], x[1]), SHORT.items(), F.when(F.lit(False), ""))
    return named.when((F.length(code) > 3) & (code == F.upper(code)), F.initcap(F.trim(col))).otherwise(code)


def watch_rows(df: DataFrame, source_col: str, region_col: str, date_col: str, seeded_col: str | None = None, organic_only: bool = False, regions: list[str] | None = None) -> DataFrame:
    """(Retailer, Region, date, rating) of the reviews to watch: regions by label, seeded ones left out on demand."""
    organic = ~F.coalesce(F.lower(F.trim(F.col(seeded_col).cast("string"))).isin(SEEDED), F.lit(False)) if seeded_col and organic_only else F.lit(True)
    rows = df.where(organic).select(F.trim(F.col(source_col)).alias("Retailer"), watch_region(region_col).alias("Region"), F.col(date_col).cast("timestamp").alias("date"), F.col("rating").cast("double").alias("rating"))
    rows = rows.where("Retailer != ''")
    return rows.where(F.col("Region").isin(regions)) if regions else rows


def watch_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Retailer", "Region").agg(F.count(F.lit(1)).alias("Reviews"), F.avg("rating").alias("Avg"))


def watch_kpis(rows: DataFrame) -> DataFrame:
    """Reviews and average rating by region, and of all selected regions together."""
    by = rows.rollup("Region").agg(F.grouping("Region").alias("all"), F.count(F.lit(1)).alias("reviews"), F.avg("rating").alias("avg_rating"))
    return by.select(F.when(F.col("all") == 1, "All selected").otherwise(F.col("Region")).alias("Region"), "reviews", "avg_rating")


def watch_trend(rows: DataFrame) -> DataFrame:
    """Reviews and average rating by retailer, region and week (from Monday); rows without a date go."""
    return rows.where("date IS NOT NULL").groupBy("Retailer", "Region", F.date_trunc("week", "date").alias("week")).agg(F.count(F.lit(1)).alias("reviews"), F.avg("rating").alias("avg_rating"))


def watch_alerts(rows: DataFrame, drop: float = 0.3, min_reviews: int = 5, baseline: int = 4) -> DataFrame:
    """Retailers and regions whose average of the last week with reviews is lower by drop or more than that of the baseline weeks before it; deepest first.

    Each side of the comparison needs min_reviews reviews. Weeks are those that occur at all, the same for all groups.
    """
    weeks = rows.where("date IS NOT NULL AND rating IS NOT NULL").groupBy("Retailer", "Region", F.date_trunc("week", "date").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"))
    few = weeks.select("week").distinct().orderBy(F.desc("week")).limit(baseline + 1)
    last = few.agg(F.max("week").alias("last"))
    kept = weeks.join(F.broadcast(few), "week").crossJoin(F.broadcast(last))  # a few weeks, one row
    new = F.col("week") == F.col("last")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    by = kept.groupBy("Retailer", "Region").agg(F.max("last").alias("week"), total("n", new).alias("reviews"), total("n", ~new).alias("baseline_reviews"), total("stars", new).alias("s"), total("stars", ~new).alias("b"))
    by = by.where((F.col("reviews") >= min_reviews) & (F.col("baseline_reviews") >= min_reviews))
    by = by.withColumns({"avg_rating": F.col("s") / F.col("reviews"), "baseline_avg": F.col("b") / F.col("baseline_reviews")}).drop("s", "b")
    out = by.withColumn("change", F.round(F.col("avg_rating") - F.col("baseline_avg"), 6))
    return out.where(F.col("change") <= -drop).orderBy("change", "Retailer", "Region")


def watch_symptoms(df: DataFrame, source_col: str, region_col: str, cols: list[str], n: int = 5) -> DataFrame:
    """The n most frequent labels in the slots of each retailer and region: Retailer, Region, label, mentions, avg_rating, rank; ties by label."""
    rows = df.select(F.trim(F.col(source_col)).alias("Retailer"), watch_region(region_col).alias("Region"), F.col("rating").cast("double").alias("rating"), F.explode(symptom_array(cols)).alias("label")).where("Retailer != ''")
    by = rows.groupBy("Retailer", "Region", "label").agg(F.count(F.lit(1)).alias("mentions"), F.avg("rating").alias("avg_rating"))
    rank = F.row_number().over(Window.partitionBy("Retailer", "Region").orderBy(F.desc("mentions"), "label"))
    return by.withColumn("rank", rank).where(F.col("rank") <= n)


def use_cases(docs: DataFrame) -> DataFrame:
    """By hack_name of social mentions: how many posts, the most engaging one (ties: the largest id), its novelty and implications."""
    best = F.max_by(F.struct(F.col("content.body").alias("quote"), F.col("source.name").alias("source"), F.coalesce("metrics.engagement", F.lit(0)).alias("engagement"), "hack_implications"), F.struct(F.coalesce("metrics.engagement", F.lit(0)), "id"))
    by = docs.where("trim(hack_name) != ''").groupBy(F.trim("hack_name").alias("use_case")).agg(F.count(F.lit(1)).alias("post_count"), best.alias("best"))
    meant = F.when(F.size("best.hack_implications") > 0, F.col("best.hack_implications")).otherwise(F.array(F.lit("CONTENT_OPPORTUNITY")))
    return by.select("use_case", "post_count", F.substring("best.quote", 1, 160).alias("representative_quote"), F.col("best.source").alias("quote_source"), F.col("best.engagement").alias("quote_engagement"), F.when(F.col("best.engagement") >= 9000, "high").otherwise("medium").alias("novelty"), meant.alias("implications"))
