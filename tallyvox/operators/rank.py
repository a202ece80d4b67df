"""Orders, relevance and samples."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import any_phrase

#: Words of a question about problems, and words that no question is about.
PROBLEM = {"defect", "broken", "issue", "problem", "bad", "fail", "broke"}
STOP_WORDS = set(
    """a about after again all also am an and any are as at be because been before being best better but by can could did do does don down even every for from get
    got great had has have he her here hers him his how i if in into is it its just like love made make many me more most much my new no not now of on one only or
    other our out over product really so some than that the their them then there these they this to too use used using very was we well were what when which while
    with would you your""".split()
)
#: Words of complaint, of praise and of both, as they count for tagging.
NEGATIVE = [
    "broke", "broken", "fail", "failed", "defect", "issue", "problem", "stopped", "won't", "doesn't", "difficult", "hard", "confusing", "loud", "noise", "leak", "burned",
    "smoke", "stuck", "cracked", "itchy", "rash", "damaged", "expensive", "overpriced", "slow",
]
POSITIVE = [
    "love", "perfect", "amazing", "excellent", "great", "easy", "simple", "quiet", "durable", "worth", "recommend", "best", "happy", "works well", "works great",
    "comfortable", "stylish", "quick",
]
MIXED = ["but", "however", "although", "except", "yet", "while", "wish"]
#: Words that put a review into one of the groups of a sample.
SIGNALS = {
    "defects": ["leak", "broken", "crack", "defect", "defective", "stopped working", "won't", "wouldn't", "doesn't", "does not", "hard to", "difficult", "messy", "loud", "noisy", "disconnect", "pair", "charge", "battery", "falls flat", "frizz", "flyaways", "curl", "hold", "wears off", "itch", "rash", "shrink", "sag", "suction"],
    "mixed": ["but", "however", "although", "except", "wish", "if only", "yet", "while"],
    "maintenance": ["clean", "cleanup", "wash", "descale", "filter", "residue", "lint", "maintenance", "attachment", "attachments", "switch", "swap", "refill", "empty", "setup", "assembly", "pairing"],
    "delight": ["love", "favorite", "easy", "quiet", "comfortable", "fast", "quick", "helpful", "works great", "worth it", "smooth", "volume", "hydrat", "clear sound", "good flavor", "supportive"],
}


def sort_reviews(df: DataFrame, mode: str) -> DataFrame:
    """newest, oldest, highest, lowest, longest, most_tagged or least_tagged; nulls last, ties by review_id."""
    key = {
        "newest": F.desc_nulls_last("submission_time"), "oldest": F.asc_nulls_last("submission_time"), "highest": F.desc_nulls_last("rating"), "lowest": F.asc_nulls_last("rating"),
        "longest": F.desc_nulls_last("review_length_chars"), "most_tagged": F.desc_nulls_last("tag_count"), "least_tagged": F.asc_nulls_last("tag_count"),
    }[mode]
    return df.orderBy(key, "review_id")


def tokenize(question: str) -> list[str]:
    """The words that count, in order; one that is said twice counts twice."""
    return [t for t in re.findall(r"[a-z0-9']+", question.lower()) if len(t) > 2 and t not in STOP_WORDS]


def occurrences(text: Column, token: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)


def relevance(question: str) -> Column:
    """3 for each word of the question that occurs, 1 for each occurrence, and bonuses for low stars of problem questions, organic and long reviews."""
    text = F.lower(F.regexp_replace(F.coalesce("title_and_text", F.lit("")), r"\s+", " "))
    tokens = tokenize(question)
    score = reduce(lambda a, t: a + F.when(text.contains(t), 3.0).otherwise(0.0) + occurrences(text, t), tokens, F.lit(0.0))
    if PROBLEM & set(tokens):
        score += F.coalesce(F.greatest(6 - F.col("rating"), F.lit(0.0)), F.lit(0.0))
    score += F.when(F.coalesce("incentivized_review", F.lit(False)), 0.0).otherwise(0.5)
    return score + F.least(F.coalesce("review_length_words", F.lit(0)) / 60, F.lit(2.0))


def select_relevant(df: DataFrame, question: str, k: int = 22) -> DataFrame:
    """k reviews for a question: the most relevant, then the newest of low and of high rating to fill up, each once; with score."""
    scored = df.withColumn("score", relevance(question))
    recent = [F.desc_nulls_last("submission_time"), F.col("review_id")]
    some = max(k // 3, 1)
    parts = [
        scored.orderBy(F.desc("score"), *recent).limit(k),
        scored.where("rating BETWEEN 1 AND 2").orderBy(*recent).limit(some),
        scored.where("rating BETWEEN 4 AND 5").orderBy(*recent).limit(some),
    ]
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])  # k + 2k/3 rows at most
    once = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("review_id").orderBy("_part"))).where("_rn = 1")
    return once.orderBy("_part", F.desc("score"), *recent).limit(k).drop("_part", "_rn")


def _text() -> Column:
    return F.coalesce("title_and_text", F.lit(""))


def _words() -> Column:
    return F.coalesce(F.col("review_length_words").try_cast("double"), F.size(F.split(F.trim(_text()), r"\s+")).cast("double"), F.lit(0.0))


def tagging_priority() -> Column:
    """How much a review (title_and_text, rating, review_length_words) is worth tagging: extreme ratings, length, and words of complaint, praise or both.

    A review without a rating counts as three stars.
    """
    text, stars = F.lower(_text()), F.coalesce(F.col("rating").try_cast("double"), F.lit(3.0))
    count = lambda words, cap: F.least(F.regexp_count(text, F.lit(any_phrase(words))), F.lit(cap))
    points = F.when(stars <= 2, 4.0).when(stars >= 4.5, 2.5).when(stars.between(2.5, 3.5), 1.2).otherwise(0.0)
    return points + F.least(_words(), F.lit(500.0)) / 120 + count(NEGATIVE, 4) * 0.9 + count(POSITIVE, 4) * 0.45 + count(MIXED, 2) * 0.9 + F.least(F.length(text), F.lit(1200)) / 1500


def prioritize_for_tagging(df: DataFrame) -> DataFrame:
    return df.withColumn("priority", tagging_priority())


def sample_reviews(df: DataFrame, n: int, time_col: str = "submission_time") -> DataFrame:
    """review_id, position and stage of at most n reviews: by stars, then by signals, then by priority; none twice.

    Stage 0 takes ceil(0.34 n / star values that occur) of each star, stage 1 ceil(0.5 n / signals) of each signal in
    the order defects, mixed, maintenance, recent (if any row has a time), delight, long; stage 2 fills up. Blank texts
    are left out, ties go by review_id. Each group sends its first 2 n rows only, so the last step, which picks in
    order, has at most 24 n rows however long the table is.
    """
    stars = F.least(F.greatest(F.bround(F.coalesce(F.col("rating").try_cast("double"), F.lit(3.0))), F.lit(1.0)), F.lit(5.0)).cast("int")
    text = F.lower(_text())
    rows = df.where(F.trim(_text()) != "").select("review_id", F.col(time_col).alias("at"), stars.alias("star"), _words().alias("words"), tagging_priority().alias("priority"), *[text.rlike(any_phrase(w)).alias(f"is_{k}") for k, w in SIGNALS.items()])
    facts = rows.agg(F.when(F.count("*") >= 4, F.expr("percentile(words, 0.75)")).otherwise(F.max("words")).alias("long_at"), F.collect_set("star").alias("stars"), F.count("at").alias("timed"))
    rows = rows.crossJoin(F.broadcast(facts))  # one row
    by_priority = F.struct(F.col("priority").alias("a"), F.lit(0.0).alias("b"))
    group = lambda name, when, key: F.when(when, F.struct(F.lit(name).alias("name"), key.alias("key")))
    groups = F.array_compact(
        F.array(
            group("all", F.lit(True), by_priority),
            F.struct(F.concat(F.lit("star"), F.col("star").cast("string")).alias("name"), by_priority.alias("key")),
            *[group(k, F.col(f"is_{k}"), by_priority) for k in SIGNALS],
            group("recent", F.col("at").isNotNull(), F.struct(F.unix_timestamp("at").cast("double").alias("a"), F.col("words").alias("b"))),
            group("long", F.col("words") >= F.col("long_at"), F.struct(F.col("words").alias("a"), F.col("priority").alias("b"))),
        )
    )
    each = rows.select("review_id", "stars", "timed", F.explode(groups).alias("group")).select("review_id", "stars", "timed", "group.name", "group.key")
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("key"), "review_id"))
    first = each.withColumn("place", place).where(F.col("place") <= 2 * n)

    def pick(held: pd.DataFrame) -> pd.DataFrame:
        order = {name: list(g.sort_values("place")["review_id"]) for name, g in held.groupby("name")}
        present = sorted(held["stars"].iloc[0])
        signals = ["defects", "mixed", "maintenance", *["recent"] * bool(held["timed"].iloc[0]), "delight", "long"]
        plan = [(f"star{s}", max(1, -(-34 * n // (100 * len(present)))), 0) for s in present]
        plan += [(s, max(1, -(-n // (2 * len(signals)))), 1) for s in signals] + [("all", n, 2)]
        taken: dict = {}
        for name, quota, stage in plan:
            fresh = [i for i in order.get(name, []) if i not in taken][: max(0, min(quota, n - len(taken)))]
            taken.update((i, stage) for i in fresh)
        return pd.DataFrame({"review_id": list(taken), "position": range(1, len(taken) + 1), "stage": list(taken.values())})

    return first.groupBy().applyInPandas(pick, "review_id string, position int, stage int")


def opportunity_top(table: DataFrame, n: int = 15, baseline: float = 0.0) -> DataFrame:
    """The n labels with the largest absolute impact among those with an average star; ties by label.

    A table without impact goes by its forecast, one without that by mentions times the distance from the baseline.
    """
    by = next((F.abs(c) for c in ("impact", "forecast") if c in table.columns), F.col("mentions") * F.abs(F.col("avg_star") - baseline))
    return table.where("avg_star IS NOT NULL").orderBy(F.desc_nulls_last(by), F.desc("mentions"), "label").limit(n)
