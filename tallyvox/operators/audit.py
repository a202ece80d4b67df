"""Reports on tag results: (key, dets, dels, ev_det, ev_del), labels of either side and the evidence texts of each label.

Reports that only count reviews also take rows that stand for several of them, with their number in a column n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import OVERALL_LABELS, any_phrase, region_label
from ..functions.wording import stems
from .links import components
from .matching import NEGATIVE, POSITIVE

ALL, UNTAGGED = "(all)", "(untagged)"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _reviews(tags: DataFrame) -> Column:
    """How many reviews a row stands for."""
    return F.col("n") if "n" in tags.columns else F.lit(1)


def _total(n: Column) -> Column:
    return F.coalesce(F.sum(n), F.lit(0))


def sides_long(tags: DataFrame) -> DataFrame:
    """(side, label), and n if tags has it: a row for each label of each review, and rows of side both for the review itself and for one without labels."""
    side = lambda c, name: F.transform(_list(c), lambda x: F.struct(F.lit(name).alias("side"), x.alias("label")))
    own = lambda label: F.struct(F.lit("both").alias("side"), F.lit(label).alias("label"))
    none = F.size(_list("dets")) + F.size(_list("dels")) == 0
    rows = F.concat(F.array(own(ALL)), F.filter(F.array(own(UNTAGGED)), lambda _: none), side("dets", "detractor"), side("dels", "delighter"))
    return tags.select(*[c for c in ("n",) if c in tags.columns], F.inline(rows))


def _counts(tags: DataFrame) -> DataFrame:
    rows = sides_long(tags)
    return rows.groupBy("side", "label").agg(F.sum(_reviews(rows)).alias("n"))


def label_counts(tags: DataFrame) -> DataFrame:
    """(side, label, n): how many reviews have each label, without a look at their evidence."""
    return _counts(tags).where("side != 'both'")


def tag_long(tags: DataFrame) -> DataFrame:
    """(key, side, label, evidence array) for each label of each review; evidence is null where the label has no entry."""
    side = lambda c, ev, name: F.transform(_list(c), lambda x: F.struct(F.lit(name).alias("side"), x.alias("label"), F.try_element_at(F.col(ev), x).alias("evidence")))
    return tags.select("key", F.inline(F.concat(side("dets", "ev_det", "detractor"), side("dels", "ev_del", "delighter"))))


def key_labels(tags: DataFrame) -> DataFrame:
    """(key, side, label) for each label of each review, without a look at their evidence."""
    side = lambda c, name: F.transform(_list(c), lambda x: F.struct(F.lit(name).alias("side"), x.alias("label")))
    return tags.select("key", F.inline(F.concat(side("dets", "detractor"), side("dels", "delighter"))))


def tag_distribution(tags: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """side, label, mentions, pct of all reviews, and whether a label is single, dominant (over half the reviews) or at times without evidence."""
    total = tags.agg(_total(_reviews(tags)).alias("total"))
    side = lambda c, ev, name: F.transform(_list(c), lambda x: F.struct(F.lit(name).alias("side"), x.alias("label"), F.try_element_at(F.col(ev), x).isNull().alias("bare")))
    long = tags.select(_reviews(tags).alias("n"), F.inline(F.concat(side("dets", "ev_det", "detractor"), side("dels", "ev_del", "delighter"))))
    by = long.groupBy("side", "label").agg(F.sum("n").alias("mentions"), _total(F.when(F.col("bare"), F.col("n"))).alias("without_evidence"))
    out = by.crossJoin(F.broadcast(total))  # one row
    return out.select("side", "label", "mentions", "without_evidence", F.bround(F.col("mentions") / F.col("total") * 100, 1).alias("pct"), (F.col("mentions") < min_occurrences).alias("singleton"), (F.col("mentions") > F.col("total") * 0.5).alias("dominant"))


def shared_evidence(tags: DataFrame, labels: int = 3, chars: int = 60, least: int = 10) -> DataFrame:
    """Evidence texts (their first chars, lower case) that stand for several different labels."""
    key = F.substring(F.lower(F.trim("text")), 1, chars)
    rows = tag_long(tags).select("label", F.explode("evidence").alias("text")).select("label", key.alias("evidence")).where(F.length("evidence") >= least).distinct()
    return rows.groupBy("evidence").agg(F.array_sort(F.collect_list("label")).alias("labels")).where(F.size("labels") >= labels)  # one entry for each label of the catalog at most


def polarity_mismatches(tags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews (key, rating) of five stars with detractors only, and of two or fewer with delighters only. All of them: take a limit for display."""
    dets, dels = F.size(_list("dets")) > 0, F.size(_list("dels")) > 0
    issue = F.when((F.col("rating") >= 5) & dets & ~dels, "5star_only_detractors").when((F.col("rating") <= 2) & dels & ~dets, "low_star_only_delighters")
    return tags.join(reviews.select("key", "rating"), "key").select("key", "rating", issue.alias("issue"), F.slice(F.concat(_list("dets"), _list("dels")), 1, 3).alias("labels")).where("issue IS NOT NULL")


def alerts_of_counts(counts: DataFrame, catalog: DataFrame, min_reviews: int = 15) -> DataFrame:
    """Alerts from (side, label, n): labels of the catalog (label, side) on over 45 % of reviews, those without hits after 20 reviews, and over half the reviews untagged."""
    number = lambda label: F.coalesce(F.sum(F.when((F.col("side") == "both") & (F.col("label") == label), F.col("n"))), F.lit(0))
    facts = counts.agg(number(ALL).alias("total"), number(UNTAGGED).alias("untagged")).where(F.col("total") >= min_reviews)
    pct = lambda n: F.bround(n / F.col("total") * 100, 1)
    known = catalog.select("label", "side").distinct().join(counts, ["label", "side"], "left").crossJoin(F.broadcast(facts))  # one row
    hits = F.coalesce("n", F.lit(0))
    issue = F.when(hits / F.col("total") > 0.45, "too_broad").when((hits == 0) & (F.col("total") >= 20), "zero_hits")
    labels = known.select("label", "side", issue.alias("issue"), pct(hits).alias("pct"), hits.alias("count")).where("issue IS NOT NULL")
    bare = facts.where("untagged / total > 0.5").select(F.lit("(overall)").alias("label"), F.lit("both").alias("side"), F.lit("high_zero_rate").alias("issue"), pct(F.col("untagged")).alias("pct"), F.col("untagged").alias("count"))
    return labels.unionByName(bare)


def label_alerts(tags: DataFrame, catalog: DataFrame, min_reviews: int = 15) -> DataFrame:
    return alerts_of_counts(_counts(tags), catalog, min_reviews)


def calibration_report(tags: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: reviews, hit rate, tags for each review, and how many labels of the catalog are unused, with a recommendation."""
    size, n = F.size(_list("dets")) + F.size(_list("dels")), _reviews(tags)
    mean = lambda value: F.coalesce(F.try_divide(F.sum(value * n), F.sum(n)), F.lit(0.0))
    facts = tags.agg(_total(n).alias("reviews"), mean((size > 0).cast("int")).alias("hit_rate"), mean(size).alias("avg_tags"))
    unused = catalog.select("label", "side").distinct().join(label_counts(tags), ["label", "side"], "left_anti").agg(F.count(F.lit(1)).alias("unused_labels"))
    advice = F.when((F.col("hit_rate") >= 0.6) & (F.col("avg_tags") >= 1.5), "ready").when(F.col("hit_rate") >= 0.3, "needs_tuning").otherwise("review_taxonomy")
    return facts.crossJoin(unused).withColumn("recommendation", advice)  # one row each


def candidate_labels(unlisted: DataFrame, refs: int = 50, parts: int | None = None) -> DataFrame:
    """Unlisted labels (key, side, label) by side: count, the count on the other side, and up to refs review keys, the smallest; most frequent first.

    Keys are ranked inside each label by a window, so that a frequent label never gathers all its keys in one row.
    Equal rows meet in one task, which holds all rows of its keys: parts deals the keys to so many tasks where the session's number is too small for them.
    """
    rows = unlisted.select("key", "side", F.initcap(F.trim(F.regexp_replace("label", r"\s+", " "))).alias("label")).where("label != ''")
    rows = (rows if parts is None else rows.repartition(parts, "key")).distinct()
    by = rows.groupBy("label").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("detractor", "delighter")])
    long = by.select("label", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("count"), F.col(o).alias("other_side")) for s, o in (("detractor", "delighter"), ("delighter", "detractor"))]))).where("count > 0")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("side", "label").orderBy("key"))).where(F.col("_n") <= refs).groupBy("side", "label").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return long.join(few, ["side", "label"]).orderBy(F.desc("count"), "label", "side")


def taxonomy_summary(rows: DataFrame) -> DataFrame:
    """By side and theme of a taxonomy (side, theme, label, bucket): the number of labels, and of those in each bucket."""
    by = rows.groupBy("side", "theme").agg(F.countDistinct("label").alias("labels"), *[F.count(F.when(F.col("bucket") == b, 1)).alias(a) for a, b in (("category", "Category Driver"), ("product", "Product Specific"), ("universal", "Universal Neutral"))])
    return by.orderBy("side", F.desc("labels"), "theme")


def region_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct regions that the locale, country and location columns name, each with its rows; unknown ones left out."""
    regions = F.array_distinct(F.filter(F.array(*[region_label(c) for c in cols]), lambda r: r != "Unknown"))
    return df.select(F.explode(regions).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("reviews"))


def ensure_universal(labels: Column, side: str) -> Column:
    """The side's overall label before the others, once."""
    return F.array_distinct(F.concat(F.array(F.lit(OVERALL_LABELS[0 if side == "detractor" else 1])), labels))


def strip_universal(labels: Column) -> Column:
    return F.filter(labels, lambda x: ~x.isin(OVERALL_LABELS))


def strip_overall_fallback(labels: Column) -> Column:
    """Without the overall labels if there is any other."""
    rest = strip_universal(labels)
    return F.when(F.size(rest) > 0, rest).otherwise(labels)


def filter_symptom_table(table: DataFrame, search: str = "", min_mentions: int = 0, min_pct: float = 0.0, sort: str = "mentions", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of a symptom table whose label (or theme) holds the text, with enough mentions; sorted, ties by label."""
    cols = [c for c in ("label", "theme") if c in table.columns]
    out = table.where((F.col("mentions") >= min_mentions) & (F.col("pct_tagged") >= min_pct))
    if search:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(search.lower())))
    out = out.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), cols[0])
    return out if limit is None else out.limit(limit)


def plan_batches(reviews: DataFrame, target_tokens: int = 4000, long_chars: int = 600, least: int = 2, most: int = 10) -> DataFrame:
    """For each review its token estimate, its route (short or long), and how many of its kind fit into a batch of target_tokens, least to most."""
    chars = F.length(F.coalesce("review_text", F.lit("")))
    tokens = F.greatest(F.ceil(chars / 3.5), F.lit(1))
    return reviews.select("review_id", tokens.alias("tokens"), F.when(chars > long_chars, "long").otherwise("short").alias("route"), F.least(F.greatest(F.floor(F.lit(target_tokens) / tokens), F.lit(least)), F.lit(most)).alias("batch_size"))


def number_batches(reviews: DataFrame, shards: int = 64, **limits: int) -> DataFrame:
    """plan_batches with shard and batch: reviews of one route and batch size, in order of review_id, so many to a batch. Reviews are dealt to shards by a hash of their id, so no order over all of them is needed; a batch is (shard, route, batch_size, batch)."""
    planned = plan_batches(reviews, **limits).withColumn("shard", F.pmod(F.xxhash64("review_id"), F.lit(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard", "route", "batch_size").orderBy("review_id"))
    return planned.withColumn("batch", F.floor((place - 1) / F.col("batch_size")))


def flag_missed_side(tags: DataFrame, reviews: DataFrame) -> DataFrame:
    """tags with missed_dets and missed_dels: sides to look at again. Both where there is no label; a side without labels where the stars (three without any) or words of the text speak for it."""
    both = tags.join(reviews.select("key", "rating", "review_text"), "key", "left")
    stars, text = F.coalesce(F.col("rating").try_cast("double"), F.lit(3.0)), F.lower(F.coalesce("review_text", F.lit("")))
    dets, dels = F.size(_list("dets")) == 0, F.size(_list("dels")) == 0
    missed = lambda none, by_stars, words: (dets & dels) | (none & (by_stars | text.rlike(any_phrase(words))))
    return both.withColumns({"missed_dets": missed(dets, stars <= 3, NEGATIVE), "missed_dels": missed(dels, stars >= 3, POSITIVE)}).drop("rating", "review_text")


def cache_key(text: str, catalog_hash: str, model: str) -> Column:
    """The key of a text's tags: the trimmed text, the catalog and the model that gave them."""
    return F.sha2(F.concat_ws("\u0001", F.trim(F.coalesce(text, F.lit(""))), F.lit(catalog_hash), F.lit(model)), 256)


def reuse_tags(reviews: DataFrame, cache: DataFrame, catalog_hash: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(known, open): reviews whose text, catalog and model are in the cache (cache_key, result), with the result; and one review for each text that is not."""
    keyed = reviews.withColumn("cache_key", cache_key("review_text", catalog_hash, model))
    known = keyed.join(cache.dropDuplicates(["cache_key"]), "cache_key")
    open_ = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by(F.struct(*reviews.columns), "review_id").alias("r")).select("cache_key", "r.*")
    return known, open_


def flag_for_verification(tags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Tags with needs_verification: long texts without labels, two labels with thin evidence (under three words), extreme stars with the other side only, or many labels on a short text."""
    both = tags.join(reviews.select("key", "rating", "review_text"), "key", "left")
    dets, dels = F.size(_list("dets")), F.size(_list("dels"))
    text = F.trim(F.regexp_replace(F.coalesce("review_text", F.lit("")), r"\s+", " "))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    strong = lambda e: F.size(F.split(F.trim(e), r"\s+")) >= 3
    thin = lambda c, ev: F.size(F.filter(_list(c), lambda x: ~F.coalesce(F.exists(F.try_element_at(F.col(ev), x), strong), F.lit(False))))
    against = ((F.col("rating") >= 4.8) & (dets > 0) & (dels == 0)) | ((F.col("rating") <= 1.2) & (dels > 0) & (dets == 0))
    crowded = ((words < 40) & (dets + dels > 4)) | ((words < 80) & (dets + dels >= 6))
    doubt = ((dets + dels == 0) & (words > 50)) | (thin("dets", "ev_det") + thin("dels", "ev_del") >= 2) | F.coalesce(against, F.lit(False)) | crowded
    return both.withColumn("needs_verification", doubt).drop("rating", "review_text")


def taxonomy_recommendations(tags: DataFrame, catalog: DataFrame) -> DataFrame:
    """action, side, label, count and priority: labels of the catalog without hits (15 reviews at least) go, those on over 40 % are split, labels that share their stems are merged (keep / merge), and unlisted labels (unl_dets, unl_dels) on 5 % and three reviews are promoted. None under five reviews."""
    total = tags.agg(_total(_reviews(tags)).alias("total")).where("total >= 5")
    hits = label_counts(tags).withColumnRenamed("n", "count")
    known = catalog.select("side", "label").distinct().join(hits, ["side", "label"], "left").fillna(0, ["count"])
    gone = known.where("count = 0").crossJoin(F.broadcast(total)).where("total >= 15").select(F.lit("remove").alias("action"), "side", "label", "count", F.lit("medium").alias("priority"))  # one row of totals
    wide = hits.crossJoin(F.broadcast(total)).where("count > total * 0.4").select(F.lit("split").alias("action"), "side", "label", "count", F.lit("high").alias("priority"))
    side = lambda c, name: F.transform(_list(c), lambda x: F.struct(F.lit(name).alias("side"), x.alias("label")))
    new = tags.select(_reviews(tags).alias("n"), F.inline(F.concat(side("unl_dets", "detractor"), side("unl_dels", "delighter")))).groupBy("side", "label").agg(F.sum("n").alias("count"))
    up = new.crossJoin(F.broadcast(total)).where("count >= greatest(3, total * 0.05)").select(F.lit("promote").alias("action"), "side", "label", "count", F.when(F.col("count") >= F.col("total") * 0.1, "high").otherwise("medium").alias("priority"))
    order = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    same = similar_labels(known.where("count > 0")).select(F.lit("merge").alias("action"), "side", F.concat_ws(" / ", "keep", "merge").alias("label"), F.col("merge_count").alias("count"), F.lit("medium").alias("priority"))
    return gone.unionByName(wide).unionByName(same).unionByName(up).orderBy(order("priority", ["high", "medium"]), order("action", ["promote", "split", "merge", "remove"]), F.desc("count"), "side", "label")


def similar_labels(counts: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(side, keep, merge, merge_count): pairs of labels (side, label, count) that share stems; the more frequent is kept, of equal ones the first.

    Labels meet by a stem that both have, not each with each.
    """

    def stemmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(stems=[sorted(stems(x)) for x in f["label"]])

    rows = counts.select("side", "label", F.col("count").cast("long")).mapInPandas(stemmed, "side string, label string, count long, stems array<string>")
    each = rows.withColumn("stem", F.explode("stems"))
    a, b = (each.select("side", "stem", F.col("label").alias(f"label_{x}"), F.col("count").alias(f"count_{x}"), F.col("stems").alias(f"stems_{x}")) for x in "ab")
    pairs = a.join(b, ["side", "stem"]).where("label_a < label_b").drop("stem").distinct()
    shared = F.size(F.array_intersect("stems_a", "stems_b")) / F.greatest(F.size("stems_a"), F.size("stems_b"))
    first = F.col("count_a") >= F.col("count_b")
    return pairs.where(shared >= threshold).select("side", F.when(first, F.col("label_a")).otherwise(F.col("label_b")).alias("keep"), F.when(first, F.col("label_b")).otherwise(F.col("label_a")).alias("merge"), F.least("count_a", "count_b").alias("merge_count"))


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """candidate_labels with near-duplicates of a side as merged_into: of all labels that hang together through shared stems the most frequent, of equal ones the first; null for that one and for labels without a near-duplicate."""
    node = lambda label: F.to_json(F.struct("side", F.col(label).alias("label")))
    near = similar_labels(candidates.select("side", "label", "count")).select(node("keep").alias("a"), node("merge").alias("b"))
    rooted = candidates.withColumn("node", node("label")).join(components(near), "node")
    best = rooted.groupBy("root").agg(F.min(F.struct((-F.col("count")).alias("n"), "label"))["label"].alias("merged_into"))
    into = rooted.join(best, "root").where("label != merged_into").select("side", "label", "merged_into")
    return candidates.join(into, ["side", "label"], "left")
