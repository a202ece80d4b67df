"""SKU catalogs, the join of reviews to them, and directories of products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import blank_to_null, clean
from ..functions.wording import likeness

#: Probes in order: (column of the review, key of the catalog, name of the match).
PROBES = [
    ("product_id", "sku_key", "product_to_sku"),
    ("sku_item", "sku_key", "sku_item_to_sku"),
    ("base_sku", "sku_key", "base_to_sku"),
    ("base_sku", "master_item_key", "base_to_master"),
    ("product_id", "master_item_key", "product_to_master"),
    ("sku_item", "master_item_key", "sku_item_to_master"),
]
MAPPED = ["sku", "master_item", "base_model_number", "brand", "category", "subcategory", "subsub_category", "region", "item_status", "lifecycle_phase", "description", "user_item_type", "item_class", "item_long_description", "ean", "upc"]
#: Headers of a master mapping, "Lifecyle" included.
HEADERS = {
    "SKU": "sku", "Master Item": "master_item", "Brand": "brand", "Category": "category", "SubCategory": "subcategory", "SubsubCategory": "subsub_category",
    "REGION": "region", "Item Status": "item_status", "Lifecyle Phase": "lifecycle_phase", "Description": "description",
    "User Item Type": "user_item_type", "Item Class": "item_class", "Item Long Description": "item_long_description", "EAN": "ean", "UPC": "upc",
}
#: Headers of a second vendor's catalog by column, the first that is there counts.
VENDOR_HEADERS = {
    "sku": ["PID", "Product ID"], "master_item": ["Model Code", "Master Item"], "category": ["Category"], "subcategory": ["Sub-Category", "SubCategory"], "subsub_category": ["SubsubCategory"],
    "region": ["Region", "REGION"], "item_status": ["Item Status"], "lifecycle_phase": ["Lifecycle Phase", "Lifecyle Phase"], "description": ["Product Name"], "user_item_type": ["Product Type"], "item_class": ["Sub-Category", "SubCategory"], "ean": ["EAN"], "upc": ["UPC"],
}


def key(col: str) -> Column:
    return F.nullif(F.upper(clean(col)), F.lit(""))


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"sku_key": key("sku"), "master_item_key": key("master_item")}).where("sku_key IS NOT NULL OR master_item_key IS NOT NULL")


def load_sku_catalog(df: DataFrame) -> DataFrame:
    """A master mapping with our column names, upper-case keys, blanks as null; base model: the master item, else the SKU. Rows without a key go."""
    found = {h.strip().lower(): h for h in df.columns}
    cols = [(blank_to_null(F.col(f"`{found[h.lower()]}`").cast("string")) if h.lower() in found else F.lit(None).cast("string")).alias(name) for h, name in HEADERS.items()]
    return _keys(df.select(*cols)).withColumn("base_model_number", F.coalesce("master_item", "sku"))


def load_vendor_catalog(df: DataFrame, default_brand: str) -> DataFrame:
    """A second vendor's catalog by its own headers (VENDOR_HEADERS); a blank brand is default_brand, and the long description joins the name, or else the base model, with colour and notes. Rows without a key go."""
    found = {h.strip().lower(): h for h in df.columns}
    take = lambda *names: next((blank_to_null(F.col(f"`{found[n.lower()]}`").cast("string")) for n in names if n.lower() in found), F.lit(None).cast("string"))
    cols = {name: take(*headers) for name, headers in VENDOR_HEADERS.items()}
    base = F.coalesce(cols["master_item"], cols["sku"])
    cols |= {"brand": F.coalesce(take("Brand"), F.lit(default_brand)), "item_long_description": F.nullif(F.concat_ws(" · ", F.coalesce(take("Product Name"), base), take("Color Variant"), take("Notes")), F.lit(""))}
    return _keys(df.select(*[cols[n].alias(n) for n in HEADERS.values()])).withColumn("base_model_number", F.coalesce("master_item", "sku"))


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def combine_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All rows, the first of each (SKU, master item, brand, category, subcategory): earlier catalogs first."""
    rows = reduce(DataFrame.unionByName, [c.withColumn("_source", F.lit(i)) for i, c in enumerate(catalogs)])
    return keep_first(rows, ["sku_key", "master_item_key", "brand", "category", "subcategory"], ["_source", "sku", "description"]).drop("_source")


def lookup_by(catalog: DataFrame, by: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order; rows without the key go."""
    return keep_first(catalog.where(F.col(by).isNotNull()), [by], order)


def _matches(keyed: DataFrame, catalog: DataFrame, order: list[str]) -> DataFrame:
    """For each distinct set of the probed keys that has a match: the keys, and _m with the row of the first probe that finds one.

    Reviews name few products many times, so their keys are made distinct first, by partial aggregation; what follows
    grows with the distinct keys. Each set of keys gives a row for each probe, all probes meet both lookups in one
    join, and of a set's hits the lowest probe stays.
    """
    names = list(dict.fromkeys(column for column, _, _ in PROBES))
    sets = keyed.select(*[f"_{c}" for c in names]).distinct()
    probe = F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("match_type"), F.lit(to).alias("kind"), F.col(f"_{column}").alias("match_key")) for i, (column, to, name) in enumerate(PROBES)]))
    probes = sets.select("*", probe).where("match_key != ''")
    kinds = list(dict.fromkeys(to for _, to, _ in PROBES))
    parts = [lookup_by(catalog, to, order).select(F.lit(to).alias("kind"), F.col(to).alias("match_key"), *[F.col(m) if m in catalog.columns else F.lit(None).cast("string").alias(m) for m in MAPPED]) for to in kinds]
    hits = probes.join(reduce(DataFrame.unionByName, parts), ["kind", "match_key"])
    return hits.groupBy(*[f"_{c}" for c in names]).agg(F.min_by(F.struct("match_type", "match_key", *MAPPED), "rank").alias("_m"))


def enrich_with_catalog(reviews: DataFrame, catalog: DataFrame, order: list[str] | None = None) -> DataFrame:
    """reviews with the catalog row that the first of six probes finds: match_type, match_key, mapped_* columns, base_model_number, master_item and mapping_detected.

    Keys are compared trimmed and in upper case; blank keys never match. Whole reviews take part in one join only, with
    the distinct keys that have a match (see _matches); Spark broadcasts those if they are small and splits the parts of
    frequent keys if not. Reviews whose keys are all blank, which match nothing, are dealt by other columns there.
    """
    order = order or ["brand", "category", "subcategory", "sku", "master_item", "description"]
    names, probed = reviews.columns, list(dict.fromkeys(column for column, _, _ in PROBES))
    keyed = reviews.withColumns({f"_{c}": F.coalesce(key(c), F.lit("")) if c in names else F.lit("") for c in probed})
    found = _matches(keyed, catalog, order)
    spread = F.concat(F.lit("blank:"), F.pmod(F.xxhash64(*[c for c in ("review_id", "product_id", "review_text") if c in names]), F.lit(100_000)).cast("string"))
    blank = F.concat(*[f"_{c}" for c in probed]) == ""
    dealt = keyed.withColumn(f"_{probed[0]}", F.when(blank, spread).otherwise(F.col(f"_{probed[0]}")))
    out = dealt.join(found, [f"_{c}" for c in probed], "left")
    first = lambda *cols: F.coalesce(*[blank_to_null(c) for c in cols if c in names], F.lit(None).cast("string"))
    named = {f"mapped_{m}": F.col(f"_m.{m}") for m in MAPPED if m not in ("base_model_number", "master_item")}
    return out.withColumns(
        {"match_type": F.coalesce("_m.match_type", F.lit("unmatched")), "match_key": F.col("_m.match_key"), **named, "base_model_number": F.coalesce("_m.base_model_number", first("base_sku", "product_id")), "master_item": F.coalesce("_m.master_item", first("base_sku")), "mapping_detected": F.col("_m").isNotNull()}
    ).drop("_m", *[f"_{c}" for c in probed])


def _directory(enriched: DataFrame, cols: list[str]) -> DataFrame:
    key_of = {"base_model_number": F.coalesce(blank_to_null("base_model_number"), blank_to_null("base_sku"), blank_to_null("product_id"), F.lit("UNMAPPED"))}
    keys = [key_of.get(c, F.coalesce(blank_to_null(c), F.lit("UNMAPPED"))).alias(c) for c in cols]
    return enriched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("review_id").alias("review_count"), F.countDistinct("product_id").alias("product_count"), F.round(F.avg("rating"), 3).alias("avg_rating"), F.min(F.to_date("submission_time")).alias("first_date"), F.max(F.to_date("submission_time")).alias("last_date")
    )


def base_model_directory(enriched: DataFrame) -> DataFrame:
    return _directory(enriched, ["base_model_number", "mapped_brand", "mapped_category", "mapped_subcategory", "master_item"])


def product_directory(enriched: DataFrame) -> DataFrame:
    return _directory(enriched, ["product_id", "original_product_name", "base_model_number", "mapped_brand", "mapped_category", "mapped_subcategory", "master_item"])


FACETS = ["base_model_number", "mapped_brand", "mapped_category", "mapped_subcategory", "product_id"]


def selected(df: DataFrame, selection: dict[str, list[str]], skip: str | None = None) -> DataFrame:
    """Rows whose columns have one of the selected values, for each column with a selection."""
    for column, values in selection.items():
        if values and column != skip:
            df = df.where(F.col(column).isin(values))
    return df


def facet_options(directory: DataFrame, limit: int = 5000, **selection: list[str]) -> DataFrame:
    """(field, value, review_count): for each field what the other fields' selection leaves, the most reviewed first, at most limit values of each.

    One pass: a directory row counts for every field if it fits all selections, for one field only if that field's
    selection is the one that it does not fit, else for none.
    """
    fits = {f: F.coalesce(F.col(f).isin(selection[f]), F.lit(False)) if selection.get(f) else F.lit(True) for f in FACETS}
    others = [c for c in selection if c not in FACETS]
    rows = selected(directory, {c: selection[c] for c in others}).withColumn("_misses", reduce(lambda a, b: a + b, [(~x).cast("int") for x in fits.values()]))
    counts = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), ((F.col("_misses") == 0) | ((F.col("_misses") == 1) & ~x)).alias("_counts")) for f, x in fits.items()]))
    by = rows.where("_misses <= 1").select("row_count", counts).where("_counts").groupBy("field", "value").agg(F.sum("row_count").alias("review_count"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("review_count"), "value"))
    return by.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def selection_count(directory: DataFrame | None, reviews: DataFrame | None = None, **selection: list[str]) -> DataFrame:
    """The number of reviews of a selection, from the directory; without one, by counting reviews."""
    if directory is None:
        return selected(reviews, selection).agg(F.count(F.lit(1)).alias("review_count"))
    return selected(directory, selection).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("review_count"))


def import_manifest(enriched: DataFrame) -> DataFrame:
    mapped = F.coalesce(F.col("mapping_detected"), F.lit(False))
    base = F.coalesce(blank_to_null("base_model_number"), F.lit("UNMAPPED"))
    return enriched.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("product_id").alias("product_count"), F.countDistinct(base).alias("base_model_count"), F.count_if(mapped).alias("mapped_count"), F.count_if(~mapped).alias("unmatched_count"))


SEARCHED = ["base_model_number", "product_id", "original_product_name", "mapped_brand", "mapped_category", "mapped_subcategory"]
CODES, FAR_NAMES = ("base_model_number", "product_id"), ("original_product_name", "mapped_category", "mapped_subcategory")
#: Points of a field that is, starts with or holds the query, as written or by its letters and digits, for codes and for names.
TIERS = [
    ("written", "is", 420, 360), ("written", "starts", 300, 245), ("written", "holds", 255, 205),
    ("letters", "is", 430, 370), ("letters", "starts", 310, 255), ("letters", "holds", 265, 215),
]
#: Points of a word in common (codes, names); likeness that counts, with points and factor (codes, names) or (far names, others); points of a base model for a code; reviews a point, at most.
WORD_POINTS = (26, 16)
ALIKE, ALIKE_POINTS, ALIKE_FACTOR = 0.72, 120, (150, 120)
NEAR, NEAR_POINTS, NEAR_FACTOR = 0.58, 70, (100, 80)
CODE_BONUS, REVIEWS_A_POINT, MOST_OF_REVIEWS = 18, 500, 18


def _alike(keys: DataFrame, letters: str) -> DataFrame:
    """(key, ratio) of the distinct keys whose likeness to letters is NEAR or more; keys whose length forbids it are not compared."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ratio=[likeness(letters, k) for k in f["key"]])

    n, own = F.length("key"), len(letters)
    able = (n > 0) & (2 * F.least(n, F.lit(own)) >= NEAR * (n + own))
    return keys.where(able).distinct().mapInPandas(compare, "key string, ratio double").where(F.col("ratio") >= NEAR)


def entity_scores(rows: DataFrame, query: str) -> DataFrame:
    """rows (entity_type, SEARCHED, review_count) with score, the points of a query.

    Each field is a row of its own for a while, with its points as columns; the fields' points meet in the order of
    SEARCHED: the higher of what was there and the field's tier, and its words in common, at least its likeness. Only
    distinct keys of fitting length are compared by likeness.
    """
    text = " ".join(query.lower().split())
    letters, words = re.sub(r"[^a-z0-9]+", "", text), sorted({w for w in re.split(r"[^a-z0-9]+", text) if w})
    names = rows.columns
    field = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c in CODES).alias("code"), F.lit(c in FAR_NAMES).alias("far"), F.lower(F.trim(F.coalesce(c, F.lit("")))).alias("written")) for i, c in enumerate(SEARCHED)]))
    fields = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", field).withColumn("letters", F.regexp_replace("written", "[^a-z0-9]+", ""))
    either = lambda pair: F.when(F.col("code"), pair[0]).otherwise(pair[1])
    fits = {"is": lambda c, q: F.col(c) == q, "starts": lambda c, q: F.col(c).startswith(q), "holds": lambda c, q: F.col(c).contains(q)}
    queries = {"written": text, "letters": letters}
    tier = F.greatest(F.lit(0), *[F.when(fits[how](c, queries[c]) & (F.col(c) != ""), either(points)).otherwise(0) for c, how, *points in TIERS if queries[c]])
    shared = F.size(F.array_intersect(F.split("written", "[^a-z0-9]+"), F.array(*map(F.lit, words)).cast("array<string>")))
    ratio = F.col("ratio")
    alike = F.when(ratio >= ALIKE, ALIKE_POINTS + ratio * either(ALIKE_FACTOR)).when(ratio >= NEAR, NEAR_POINTS + ratio * F.when(F.col("far"), NEAR_FACTOR[0]).otherwise(NEAR_FACTOR[1])).otherwise(0.0)
    near = _alike(fields.select(F.col("letters").alias("key")), letters)
    pointed = fields.join(near, F.col("letters") == F.col("key"), "left").withColumns({"tier": tier, "shared": shared * either(WORD_POINTS), "alike": alike})
    by_field = F.array_sort(F.collect_list(F.struct("place", F.col("tier").cast("double").alias("tier"), F.col("shared").cast("double").alias("shared"), "alike")))
    met = pointed.groupBy("_row", *names).agg(F.aggregate(by_field, F.lit(0.0), lambda s, x: F.greatest(F.greatest(s, x["tier"]) + x["shared"], x["alike"])).alias("score"))
    of_model = F.lit(CODE_BONUS if re.search(r"[a-z].*\d|\d.*[a-z]", text) else 0) * (F.col("entity_type") == "Base model").cast("int")
    return met.select(*names, (F.col("score") + of_model + F.least(F.coalesce("review_count", F.lit(0)) / REVIEWS_A_POINT, F.lit(float(MOST_OF_REVIEWS)))).alias("score"))


def search_entities(base_models: DataFrame, products: DataFrame, query: str = "", n: int = 25) -> DataFrame:
    """The n best base models and products for a query, with score; without a query the base models with the most reviews.

    Every row of both directories is scored, see entity_scores; one row for each (entity_type, base_model_number,
    product_id) counts. Ties go by reviews, base model and product.
    """
    shown = ["entity_type", *SEARCHED, "review_count", "avg_rating"]
    text = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    as_rows = lambda df, kind, hide: df.select(F.lit(kind).alias("entity_type"), *[(F.lit("") if c in hide else text(df, c)).alias(c) for c in SEARCHED], F.col("review_count").cast("long"), F.col("avg_rating").cast("double"))
    models = as_rows(base_models, "Base model", ("product_id", "original_product_name"))
    if not query.strip():
        return models.orderBy(F.desc("review_count"), "base_model_number").limit(n).withColumn("score", F.lit(0.0))

    rows = entity_scores(models.unionByName(as_rows(products, "Product", ())), query)
    key = ["entity_type", "base_model_number", "product_id"]
    best = rows.where("score > 0").groupBy(*key).agg(F.max_by(F.struct(*[c for c in shown if c not in key], "score"), F.struct("review_count", "score")).alias("r"))
    return best.select("entity_type", *[c if c in key else f"r.{c}" for c in SEARCHED], "r.review_count", "r.avg_rating", "r.score").orderBy(F.desc("score"), F.desc("review_count"), F.lower("base_model_number"), F.lower("product_id"), "entity_type").limit(n)
