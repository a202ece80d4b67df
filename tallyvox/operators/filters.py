"""Filters over reviews; each is a predicate that Spark can push to the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clean_symptom
from .products import selected

DAYS = {"last 7 days": 7, "last 30 days": 30, "last 365 days": 365}
HEAVY = ["context_json", "badges_json", "raw_json", "photo_urls"]
ANALYTICS = ["review_id", "submission_time", "rating", "incentivized_review", "review_origin_group", "review_acquisition_channel", "moderation_bucket", "country", "content_locale", "mapped_brand", "mapped_category", "mapped_subcategory", "base_model_number", "product_id", "original_product_name", "retailer"]


def filter_timeframe(df: DataFrame, timeframe: str, as_of: date, start: date | None = None, end: date | None = None) -> DataFrame:
    """The last 7, 30 or 365 days up to as_of, or start to end; both ends count to the end of their day. Anything else: all rows."""
    days = DAYS.get(timeframe.lower())
    if days:
        start, end = as_of - timedelta(days=days), as_of
    elif timeframe.lower() != "custom":
        return df
    if start:
        df = df.where(F.col("submission_time") >= F.lit(start.isoformat()).cast("timestamp"))
    return df.where(F.col("submission_time") < F.lit((end + timedelta(days=1)).isoformat()).cast("timestamp")) if end else df


def filter_stars(df: DataFrame, stars: list[int]) -> DataFrame:
    return df.where(F.col("rating").isin([float(s) for s in stars])) if stars else df


def _derived() -> dict[str, Column]:
    no = F.lit(False)
    return {
        "review_type": F.when(F.coalesce("incentivized_review", no), "Incentivized").otherwise("Organic"),
        "recommendation": F.when(F.col("is_recommended"), "Recommended").when(~F.col("is_recommended"), "Not recommended").otherwise("Unknown"),
        "syndication": F.when(F.coalesce("is_syndicated", no), "Syndicated").otherwise("Not syndicated"),
        "media": F.when(F.coalesce("has_photos", no), "With media").otherwise("Without media"),
    }


def filter_dimensions(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """One of the values in every dimension: columns, or review_type, recommendation, syndication, media."""
    derived = _derived()
    for name, values in wanted.items():
        if values:
            df = df.where(derived.get(name, F.col(name) if name in df.columns else F.lit(None)).isin(values))
    return df


#: A column with more distinct values than this is searched, not chosen from.
MOST_CHOICES = 600


def infer_kinds(df: DataFrame, cols: list[str], most: int = MOST_CHOICES) -> dict[str, str]:
    """The kind of filter that fits each column: number or date if nine tenths of its filled values are one, tokens if some hold a bar, contains if there are more than most distinct values, else values. One row of facts comes to the driver."""
    text = {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in cols}
    facts = []
    for i, c in enumerate(cols):
        facts += [F.count(text[c]).alias(f"n{i}"), F.count(text[c].try_cast("double")).alias(f"number{i}"), F.count(F.when(text[c].rlike("[-/]"), text[c].try_cast("timestamp"))).alias(f"date{i}"), F.count_if(text[c].contains("|")).alias(f"bar{i}"), F.approx_count_distinct(text[c]).alias(f"distinct{i}")]
    r = df.agg(*facts).first()
    kind = lambda i: "values" if not r[f"n{i}"] else "number" if r[f"number{i}"] >= 0.9 * r[f"n{i}"] else "date" if r[f"date{i}"] >= 0.9 * r[f"n{i}"] else "tokens" if r[f"bar{i}"] else "contains" if r[f"distinct{i}"] > most else "values"
    return {c: kind(i) for i, c in enumerate(cols)}


def filter_extra(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Filters by kind: number (min, max), date (start, end), contains (text), tokens (values of a |-separated list), values. A spec without a kind takes the one that infer_kinds finds."""
    open_ = [name for name, spec in specs.items() if "kind" not in spec]
    kinds = infer_kinds(df, open_) if open_ else {}
    for name, spec in specs.items():
        c = F.col(f"`{name}`")
        text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
        kind = spec.get("kind") or kinds[name]
        if kind == "number":
            df = df.where(c.try_cast("double").between(spec.get("min", float("-inf")), spec.get("max", float("inf"))))
        elif kind == "date":
            df = df.where((c.try_cast("date") >= F.lit(spec["start"]).cast("date")) & (c.try_cast("date") <= F.lit(spec["end"]).cast("date")))
        elif kind == "contains":
            df = df.where(text.contains(spec["text"].lower()))
        elif kind == "tokens":
            df = df.where(F.arrays_overlap(F.transform(F.split(text, r"\s*\|\s*"), lambda x: F.trim(x)), F.array(*[F.lit(v.lower()) for v in spec["values"]])))
        else:
            df = df.where(c.cast("string").isin(spec["values"]))
    return df


def filter_symptoms(df: DataFrame, detractors: list[str], delighters: list[str], det_cols: list[str], del_cols: list[str]) -> DataFrame:
    """Rows with one of the labels in a slot of either side, for each side with labels."""
    for labels, cols in ((detractors, det_cols), (delighters, del_cols)):
        if labels:
            df = df.where(F.coalesce(F.arrays_overlap(F.array_compact(F.array(*[clean_symptom(c) for c in cols])), F.array(*map(F.lit, labels))), F.lit(False)))
    return df


def filter_keyword(df: DataFrame, keyword: str) -> DataFrame:
    """The keyword, whatever its case, in title_and_text, or in review_text where there is no such column."""
    if not keyword.strip():
        return df
    return df.where(F.contains(F.lower("title_and_text" if "title_and_text" in df.columns else "review_text"), F.lit(keyword.strip().lower())))


@dataclass
class FilterSpec:
    timeframe: str = "all time"
    as_of: date = date(2000, 1, 1)
    start: date | None = None
    end: date | None = None
    stars: list[int] = field(default_factory=list)
    dimensions: dict[str, list[str]] = field(default_factory=dict)
    extra: dict[str, dict] = field(default_factory=dict)
    keyword: str = ""
    detractors: list[str] = field(default_factory=list)
    delighters: list[str] = field(default_factory=list)
    det_cols: list[str] = field(default_factory=list)
    del_cols: list[str] = field(default_factory=list)


def apply_review_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """All filters of the spec, in any order: a row stays if it passes each."""
    out = filter_timeframe(df, spec.timeframe, spec.as_of, spec.start, spec.end)
    out = filter_extra(filter_dimensions(filter_stars(out, spec.stars), spec.dimensions), spec.extra)
    return filter_keyword(filter_symptoms(out, spec.detractors, spec.delighters, spec.det_cols, spec.del_cols), spec.keyword)


def describe_filters(spec: FilterSpec) -> list[tuple[str, str]]:
    """The filters that are on, as rows of name and value."""
    rows = [("Timeframe", spec.timeframe)] if spec.timeframe != "all time" else []
    rows += [("Stars", ", ".join(map(str, spec.stars)))] if spec.stars else []
    rows += [(k, ", ".join(v)) for k, v in spec.dimensions.items() if v]
    rows += [(k, str({a: b for a, b in v.items() if a != "kind"})) for k, v in spec.extra.items()]
    rows += [(name, ", ".join(v)) for name, v in (("Detractors", spec.detractors), ("Delighters", spec.delighters)) if v]
    return rows + ([("Keyword", spec.keyword)] if spec.keyword.strip() else [])


def apply_action_filters(df: DataFrame, moderation: list[str] | None = None, organic_only: bool = False, brands: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    out = selected(df, {"moderation_bucket": moderation or [], "mapped_brand": brands or [], "country": countries or []})
    return out.where(~F.coalesce("incentivized_review", F.lit(False))) if organic_only else out


def newest_first(df: DataFrame) -> list[Column]:
    return [F.desc_nulls_last("submission_time"), F.desc_nulls_last("review_id")]


def workspace_total(df: DataFrame, **selection: list[str]) -> DataFrame:
    """One row: how many rows the selection has, before any limit."""
    return selected(df, selection).agg(F.count(F.lit(1)).alias("total"))


def load_workspace(df: DataFrame, limit: int | None = None, **selection: list[str]) -> DataFrame:
    """Selected rows without heavy columns, newest first; workspace_total counts them."""
    out = selected(df, selection).drop(*[c for c in HEAVY if c in df.columns]).orderBy(*newest_first(df))
    return out.limit(limit) if limit else out


def analytics_frame(df: DataFrame, limit: int | None = None, moderation: list[str] | None = None, brands: list[str] | None = None, countries: list[str] | None = None, organic_only: bool = False, **selection: list[str]) -> DataFrame:
    """Sixteen columns of selected and filtered rows, newest first."""
    rows = apply_action_filters(selected(df, selection), moderation, organic_only, brands, countries).orderBy(*newest_first(df))
    return (rows.limit(limit) if limit else rows).select(*[c for c in ANALYTICS if c in df.columns])


def get_reviews(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()], F.lit(True)))
