"""Label taxonomies: standard wording, themes and buckets, support in reviews, priorities, merges and product categories.

A taxonomy is small against its reviews. What needs likeness of wording runs once for each distinct label; the reviews
are met by built-in functions or, for support, by Arrow batches that carry the labels and send back counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CANONICAL, NON_VALUES, OVERALL_LABELS, any_phrase
from ..functions.phrases import LabelIndex, label_entry, labels_said, plain_text
from ..functions.wording import likeness, overlap, plain, stems
from .links import alike_candidates

#: Standard labels and the wordings that stand for them, by side. A table of our own; pass another to standardise by it.
_GOOD = {"Quiet", "Easy To Use", "Easy To Clean", "Fast Charging", "Clear Instructions", "Easy Setup"}
RULES = [("delighter" if label in _GOOD else "detractor", label, phrases) for label, phrases in CANONICAL.items()] + [
    ("delighter", "Overall Satisfaction", ["would recommend", "love it", "very happy", "satisfied"]),
    ("detractor", "Overall Dissatisfaction", ["would not recommend", "disappointed", "hate it", "not satisfied"]),
    ("delighter", "Good Value", ["great value", "value for money", "worth the price"]),
    ("detractor", "Overpriced", ["too expensive", "not worth the price", "costs too much"]),
    ("delighter", "Performs Well", ["works great", "works well", "does the job"]),
    ("detractor", "Poor Performance", ["doesn't work", "didn't work", "poor results"]),
    ("detractor", "Short Battery Life", ["battery life issue", "battery dies fast"]),
    ("detractor", "Connectivity Issues", ["connection problem", "connectivity problem", "keeps disconnecting"]),
    ("delighter", "Lightweight", ["light weight", "light to hold"]),
    ("detractor", "Heavy", ["too heavy", "heavy to hold"]),
]
#: Words that are put in place of others where no rule fits.
REWRITES = {"usability": "use", "noisy": "loud", "quiet operation": "quiet", "fast charge": "fast charging", "slow charge": "slow charging"}
#: Theme of a concept; labels of no concept are Product Specific.
THEMES = {
    "noise": "Noise", "cleaning": "Cleaning & Care", "use": "Ease Of Use", "battery": "Power & Battery", "setup": "Setup", "size": "Size & Fit", "weight": "Size & Fit", "value": "Value", "durability": "Quality & Durability",
    "speed": "Performance", "smell": "Smell & Taste", "instructions": "Setup", "performance": "Performance", "comfort": "Comfort", "overall": "Overall",
}
#: Labels that fit any product.
UNIVERSAL = {*OVERALL_LABELS, "Good Value", "Overpriced", "Performs Well", "Poor Performance", "Easy To Use", "Difficult To Use"}
BUCKETS = ["Category Driver", "Product Specific", "Universal Neutral"]
#: Words of product categories. A table of our own; pass another to infer by it.
CATEGORIES = {
    "vacuum": ["vacuum", "suction", "dust bin", "brush roll"], "hair": ["hair dryer", "frizz", "blowout", "curl"], "kitchen": ["air fryer", "blender", "recipe", "cook"], "audio": ["headphones", "speaker", "sound quality", "bass"],
    "skin": ["serum", "moisturizer", "skin care", "face cream"], "air": ["air purifier", "hepa", "allergens", "filter"], "apparel": ["shirt", "true to size", "fabric", "shoes"],
}


def clean_label(text: str | None) -> str:
    """Spaces collapsed, & as And, title case; empty for non-values."""
    value = re.sub(r"\s+", " ", (text or "").replace("&", " And ")).strip(" ,;|/")
    return "" if value.lower() in NON_VALUES else value.title()


#: Words that turn the sense of a wording round: a wording with one never stands for a label without one, nor the other way.
REVERSING = {"not", "no", "never", "without", "low", "less", "free", "zero"}


def reversed_sense(text: str) -> bool:
    """Whether a plain wording denies what its other words say."""
    return any(w in REVERSING or w.endswith("n't") for w in text.split())


def standard_label(label: str | None, side: str | None = None, rules: list[tuple[str, str, list[str]]] = RULES) -> str:
    """The standard label whose wording the label holds, is held by (from 5 letters), or shares four fifths of its stems with; of several the likest. A wording of the other sense (see REVERSING) never counts. Else the label, cleaned and rewritten."""
    cleaned = clean_label(label)
    text, own = plain(cleaned), stems(cleaned)
    sense = reversed_sense(text)
    found = []
    for rule_side, canonical, phrases in rules:
        if side and rule_side != side:
            continue
        wordings = [w for w in map(plain, (canonical, *phrases)) if reversed_sense(w) == sense]
        close = [w for w in wordings if w == text or (len(text) >= 5 and (w in text or text in w)) or overlap(own, stems(w)) >= 0.8]
        if cleaned and close:
            found.append((max(max(likeness(text, w), overlap(own, stems(w))) for w in wordings), canonical))
    if found:
        return max(found, key=lambda x: (x[0], len(x[1]), x[1]))[1]
    for old, new in REWRITES.items():
        text = re.sub(rf"\b{re.escape(old)}\b", new, text)
    return clean_label(text if text != plain(cleaned) else cleaned)


def _once(df: DataFrame, keys: list[str], work, out: str, schema: str) -> DataFrame:
    """df with a column of what work gives for each distinct combination of keys, worked out once each and joined back."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [work(*row) for row in f.itertuples(index=False)]})

    names = [f"_{k}" for k in keys]
    found = df.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)]).distinct().mapInPandas(each, ", ".join(f"{n} string" for n in names) + f", {out} {schema}")
    on = reduce(lambda a, b: a & b, [df[k].cast("string").eqNullSafe(found[n]) for k, n in zip(keys, names, strict=True)])
    return df.drop(out).join(found, on).drop(*names) if out not in df.columns else df.join(found, on).drop(*names)


def standardize_labels(df: DataFrame, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """df (label, side) with standard: empty for null, blank and non-values."""
    return _once(df, ["label", "side"], lambda label, side: standard_label(label, side, rules), "standard", "string")


def label_theme(label: Column | str, themes: dict[str, list[str]] | None = None) -> Column:
    """The theme of a label by the first theme, in the order of the table, with a word that it holds; Product Specific if none."""
    text = F.lower(F.col(label) if isinstance(label, str) else label)
    table = themes or theme_words()
    return reduce(lambda acc, x: acc.when(text.rlike(any_phrase(x[1])), x[0]), list(table.items()), F.when(text.isin([o.lower() for o in OVERALL_LABELS]), "Overall")).otherwise("Product Specific")


def theme_words() -> dict[str, list[str]]:
    """Theme and its words, from the concepts."""
    from .tagging import CONCEPTS

    out: dict[str, list[str]] = {}
    for concept, (words, good, bad) in CONCEPTS.items():
        out.setdefault(THEMES[concept], []).extend([*words, *good, *bad])
    return out


def label_bucket(label: Column | str, pack: list[str], universal: set[str] = frozenset(UNIVERSAL)) -> Column:
    """Universal Neutral, Category Driver (in the category's pack) or Product Specific."""
    name = F.col(label) if isinstance(label, str) else label
    return F.when(name.isin(sorted(universal)), "Universal Neutral").when(name.isin(sorted(pack)), "Category Driver").otherwise("Product Specific")


def _example(label_phrases: list[tuple[str, ...]]):  # noqa: ANN202
    """Of each row's text the first sentence that says a phrase of its label, else the first, cut at 140 characters."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at, text in zip(f["at"], f["text"], strict=True):
                index = LabelIndex(((label_phrases[at], ()),))
                sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
                out.append(next((s for s in sentences if index.by_phrase(plain(s))), sentences[0])[:140])
            yield f.assign(sentence=out).drop(columns="text")

    return cut


def label_support(reviews: DataFrame, catalog: list[tuple[str, str, list[str]]], examples: int = 3) -> DataFrame:
    """label, side, review_hits, support_ratio, score, specificity and examples for each (label, side, aliases) of the catalog, over all reviews (review_id, review_text).

    A review is hit by a phrase (label or alias), or by four fifths of the label's word stems; all labels are looked for
    in one pass over a text (functions.phrases), so the time hardly grows with the catalog. Hits are counted in Spark;
    the reviews with the smallest ids give the examples, and no task sends more than that many texts a label. The ratio
    is to reviews with text; blank texts count for nothing.
    """
    entries = [label_entry(label, aliases) for label, _, aliases in catalog]
    texts = reviews.select(F.col("review_id").cast("string").alias("review_id"), F.col("review_text").cast("string").alias("text")).where(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "")
    said = texts.withColumn("hit", F.explode(labels_said(plain_text(F.col("text")), entries))).select("review_id", "text", F.col("hit.label").alias("at"), "hit.by_phrase")
    by = said.groupBy("at").agg(F.count(F.lit(1)).alias("hits"), F.count_if("by_phrase").alias("phrase_hits"))
    total = texts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    spark = reviews.sparkSession
    names = spark.createDataFrame([(i, label, side, float(min(max(len(own), 1), 5))) for i, ((label, side, _), (_, own)) in enumerate(zip(catalog, entries, strict=True))], "position int, label string, side string, specificity double")
    out = names.join(by, names["position"] == by["at"], "left").drop("at").crossJoin(F.broadcast(total))  # one row
    if examples:
        first = F.row_number().over(Window.partitionBy("at").orderBy("review_id", "text"))
        shown = said.withColumn("n", first).where(F.col("n") <= examples).select("at", "n", "text").mapInPandas(_example([p for p, _ in entries]), "at int, n int, sentence string")
        shown = shown.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("examples"))
        out = out.join(shown, out["position"] == shown["at"], "left").drop("at").withColumn("examples", F.coalesce(F.col("examples")["sentence"], F.array().cast("array<string>")))
    else:
        out = out.withColumn("examples", F.array().cast("array<string>"))
    hits, ratio = F.coalesce("hits", F.lit(0)), F.coalesce("hits", F.lit(0)) / F.col("total")
    score = hits + ratio + 0.12 * F.col("specificity") + F.least(F.lit(0.35), 0.05 * F.coalesce("phrase_hits", F.lit(0)))
    return out.select("position", "label", "side", hits.alias("review_hits"), F.round(ratio, 4).alias("support_ratio"), F.round(score, 4).alias("score"), "specificity", "examples")


def prioritize_labels(candidates: DataFrame, support: DataFrame, pack: list[str], min_hits: int = 1, max_keep: int = 18, exclude_universal: bool = True) -> DataFrame:
    """At most max_keep labels of a side from candidates (label, side, aliases), the best supported first: category drivers before product specific ones.

    Candidates of one label are one row with all aliases. Category drivers need one hit, others min_hits; where no
    other reaches that, up to 6 with a hit come in. Ties go by label.
    """
    merged = candidates.where("coalesce(label, '') != ''").groupBy("label", "side").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))
    merged = merged.withColumns({"aliases": F.filter("aliases", lambda a: a != F.col("label")), "bucket": label_bucket("label", pack)})
    if exclude_universal:
        merged = merged.where("bucket != 'Universal Neutral'")
    rows = merged.join(support.select("label", "side", "review_hits", "support_ratio", "score", "specificity"), ["label", "side"], "left").fillna({"review_hits": 0, "score": 0.0, "specificity": 1.0, "support_ratio": 0.0})
    specific = F.col("bucket") == "Product Specific"
    kept = F.when(F.col("bucket") == "Category Driver", F.col("review_hits") >= 1).when(specific, F.col("review_hits") >= max(min_hits, 1)).otherwise(True)
    best = [F.desc("review_hits"), F.desc("score"), F.desc("specificity"), "label"]
    side = Window.partitionBy("side")
    rows = rows.withColumns({"kept": kept, "some": F.max(kept & specific).over(side), "place": F.row_number().over(Window.partitionBy("side", "bucket", F.col("review_hits") >= 1).orderBy(*best))})
    rows = rows.where(F.col("kept") | (~F.col("some") & specific & (F.col("review_hits") >= 1) & (F.col("place") <= min(6, max_keep))))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")), *best))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max_keep).drop("kept", "some", "place")


def canonical_catalog(labels: DataFrame, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """side, label, aliases from raw labels (label, side): standardised, each once, with the raw wordings and the rule's wordings as aliases, in order of name."""
    rows = standardize_labels(labels, rules).where("standard != ''")
    by = rows.groupBy("side", F.col("standard").alias("label")).agg(F.collect_set(F.initcap(F.trim("label"))).alias("raw"))
    wordings = [(side, canonical, [clean_label(p) for p in phrases]) for side, canonical, phrases in rules]
    known = labels.sparkSession.createDataFrame(wordings, "side string, label string, ruled array<string>").groupBy("side", "label").agg(F.flatten(F.collect_list("ruled")).alias("ruled"))
    out = by.join(F.broadcast(known), ["side", "label"], "left")
    aliases = F.array_sort(F.filter(F.array_distinct(F.concat("raw", F.coalesce("ruled", F.array().cast("array<string>")))), lambda a: (a != F.col("label")) & (a != "")))
    return out.select("side", "label", aliases.alias("aliases")).orderBy("side", "label")


def taxonomy_rows(catalog: DataFrame, support: DataFrame, pack: list[str]) -> DataFrame:
    """theme, label, side, bucket, aliases, alias_count, review_hits, support_pct and example; detractors first, then by theme, bucket, hits and label."""
    rows = catalog.join(support.select("label", "side", "review_hits", "support_ratio", F.try_element_at("examples", F.lit(1)).alias("example")), ["label", "side"], "left")
    out = rows.select(
        label_theme("label").alias("theme"), "label", "side", label_bucket("label", pack).alias("bucket"), "aliases", F.size("aliases").alias("alias_count"), F.coalesce("review_hits", F.lit(0)).alias("review_hits"), F.bround(F.coalesce("support_ratio", F.lit(0.0)) * 100, 1).alias("support_pct"), F.coalesce("example", F.lit("")).alias("example")
    )
    order = F.array_position(F.array(*map(F.lit, ["Universal Neutral", "Category Driver", "Product Specific"])), F.col("bucket"))
    return out.orderBy(F.col("side") != "detractor", "theme", order, F.desc("review_hits"), "label")


#: Likeness of wording and share of stems from which two labels are alike.
LIKE_WORDING, SHARED_STEMS = 0.84, 0.75


def _sharing_stems(labels: DataFrame) -> DataFrame:
    """(side, theme, label_a, label_b), label_a < label_b: labels of one side and theme with a stem in common."""

    def stemmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(stem=[sorted(stems(x)) for x in f["label"]])

    each = labels.select("side", "theme", "label").mapInPandas(stemmed, "side string, theme string, label string, stem array<string>").withColumn("stem", F.explode("stem"))
    a, b = (each.select("side", "theme", "stem", F.col("label").alias(f"label_{x}")) for x in "ab")
    return a.join(b, ["side", "theme", "stem"]).where("label_a < label_b").select("side", "theme", "label_a", "label_b").distinct()


def suggest_merges(rows: DataFrame, n: int = 12) -> DataFrame:
    """The n likest pairs of labels of one side and theme (side, theme, label, review_hits): keep and merge, with why and similarity.

    A pair is alike by wording (LIKE_WORDING), by shared stems (SHARED_STEMS) or if one holds the other. The label with
    more hits is kept, of equal ones the shorter. Labels meet by rare pairs of characters (links.alike_candidates) or by
    a stem that both have; only such pairs are compared, and none that is alike is lost. Labels without a letter or
    digit are like none.
    """
    hits = rows.groupBy("side", "theme", "label").agg(F.max(F.coalesce("review_hits", F.lit(0)).cast("long")).alias("hits")).where("label IS NOT NULL")
    pairs = alike_candidates(hits, ["side", "theme"], "label", LIKE_WORDING).unionByName(_sharing_stems(hits)).distinct()
    for x in "ab":
        pairs = pairs.join(hits.select("side", "theme", F.col("label").alias(f"label_{x}"), F.col("hits").alias(f"hits_{x}")), ["side", "theme", f"label_{x}"])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for side, theme, a, hits_a, b, hits_b in f.itertuples(index=False):
                x, y = plain(a), plain(b)
                ratio, shared, held = likeness(x, y), overlap(stems(a), stems(b)), bool(x and y) and (x in y or y in x)
                if ratio < LIKE_WORDING and shared < SHARED_STEMS and not held:
                    continue
                (_, _, keep, keep_hits), (_, _, merge, merge_hits) = sorted([(-hits_a, len(a), a, hits_a), (-hits_b, len(b), b, hits_b)])
                why = [w for w, yes in (("like wording", ratio >= LIKE_WORDING), ("shared words", shared >= SHARED_STEMS), ("one holds the other", held)) if yes]
                out.append((side, theme, keep, merge, keep_hits, merge_hits, ", ".join(why), round(max(ratio, shared), 2)))
            yield pd.DataFrame(out, columns=["side", "theme", "keep", "merge", "keep_hits", "merge_hits", "why", "similarity"])

    found = pairs.select("side", "theme", "label_a", "hits_a", "label_b", "hits_b").mapInPandas(judge, "side string, theme string, keep string, merge string, keep_hits long, merge_hits long, why string, similarity double")
    return found.orderBy(F.desc("similarity"), F.desc("keep_hits"), F.length("keep"), "keep", "merge").limit(n)


def dedupe_labels(labels: DataFrame, threshold: float = 0.55) -> DataFrame:
    """side, label, aliases from (side, position, label): in order, a label that shares enough stems with one kept before becomes its alias. The labels of a side are one group: a taxonomy is small."""

    def merge(held: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, frozenset, list[str]]] = []
        for label in held.sort_values(["position", "label"])["label"]:
            if not isinstance(label, str) or not label.strip():
                continue
            own = stems(label)
            home = next((k for k in kept if own and overlap(own, k[1]) >= threshold), None)
            if home is None:
                kept.append((label.strip(), own, []))
            elif label.strip() != home[0] and label.strip() not in home[2]:
                home[2].append(label.strip())
        side = held["side"].iloc[0]
        return pd.DataFrame([(side, label, aliases) for label, _, aliases in kept], columns=["side", "label", "aliases"])

    return labels.groupBy("side").applyInPandas(merge, "side string, label string, aliases array<string>")


def infer_category(reviews: DataFrame, descriptions: DataFrame | None = None, keywords: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    """product_id, category, confidence and signals for each product of the reviews (product_id, review_text), or general where no keyword is said.

    A keyword counts once for a product: 1 if it has several words, else 0.6, and 3.5 times that if the product's
    description (product_id, description) holds it. Confidence is the best score over the two best and a half, from 0.15
    to 0.98. Whether a keyword occurs at all is a maximum over reviews, so only one row a product and task is shuffled.
    """
    spaced = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    words = [(c, k.lower()) for c, ks in keywords.items() for k in ks]
    seen = lambda name: [F.max(F.col("t").contains(k)).alias(f"{name}{i}") for i, (_, k) in enumerate(words)]
    told = reviews.select("product_id", spaced(F.col("review_text")).alias("t")).groupBy("product_id").agg(*seen("r"))
    if descriptions is not None:
        named = descriptions.select("product_id", spaced(F.col("description")).alias("t")).groupBy("product_id").agg(*seen("d"))
        told = told.join(named, "product_id", "left")
    points = []
    for i, (_, k) in enumerate(words):
        base = 1.0 if " " in k else 0.6
        said = F.when(F.col(f"r{i}"), base).otherwise(0.0)
        points.append(F.when(F.coalesce(F.col(f"d{i}"), F.lit(False)), base * 3.5).otherwise(said) if descriptions is not None else said)
    total = lambda c: F.round(reduce(lambda a, b: a + b, [p for p, (x, _) in zip(points, words, strict=True) if x == c]), 6)
    hits = lambda c: F.slice(F.array_compact(F.array(*[F.when(p > 0, k) for p, (x, k) in zip(points, words, strict=True) if x == c])), 1, 6)
    ranked = F.array_sort(F.array(*[F.struct((-total(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("category"), hits(c).alias("signals")) for i, c in enumerate(keywords)]))
    out = told.select("product_id", ranked.alias("r"))
    best, second = -F.col("r")[0]["s"], -F.col("r")[1]["s"] if len(keywords) > 1 else F.lit(0.0)
    confidence = F.round(F.least(F.greatest(best / F.greatest(best + second + 0.5, F.lit(1.0)), F.lit(0.15)), F.lit(0.98)), 2)
    none = best <= 0
    return out.select("product_id", F.when(none, "general").otherwise(F.col("r")[0]["category"]).alias("category"), F.when(none, 0.0).otherwise(confidence).alias("confidence"), F.when(none, F.array().cast("array<string>")).otherwise(F.col("r")[0]["signals"]).alias("signals"))
