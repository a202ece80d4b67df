"""Sinks: report bundles, snapshots of directories, tags written back to their rows, and signatures of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import blank_to_null
from ..operators import metrics

#: The columns that an export of reviews puts first.
FIRST_COLUMNS = ["review_id", "product_id", "product_or_sku", "rating", "incentivized_review", "is_recommended", "submission_time", "content_locale", "retailer", "title", "review_text"]
#: The order of each table of a snapshot.
SNAPSHOT_ORDER = {
    "base_models": ["-review_count", "base_model_number"],
    "products": ["-review_count", "base_model_number", "product_id"],
    "sku_catalog": ["base_model_number", "sku"],
}


def source_signature(files: DataFrame) -> DataFrame:
    """One row, signature: changes with any (relative_path, name, size, mtime) of the files, but not with their order.

    Hashes of the rows are summed and xor-ed, so that a listing of any length needs no sort and no single large row.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("relative_path", "name", "size", "mtime")]
    row = F.to_json(F.array(*parts))
    facts = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit("signature"), row)).alias("bits"))
    return facts.select(F.sha1(F.concat_ws("|", "n", "total", "bits").cast("binary")).alias("signature"))


def export_bundle(reviews: DataFrame, out_dir: str, filters: list[tuple[str, str]] | None = None) -> None:
    """Write Summary, FilterCriteria, Reviews (the first columns first), RatingDistribution and ReviewVolume as Parquet below out_dir."""
    first = [c for c in FIRST_COLUMNS if c in reviews.columns]
    tables = {
        "Summary": metrics.compute_metrics(reviews),
        "FilterCriteria": reviews.sparkSession.createDataFrame(filters or [("Filters", "No active filters")], "field string, value string"),
        "Reviews": reviews.select(*first, *[f"`{c}`" for c in reviews.columns if c not in first]),
        "RatingDistribution": metrics.rating_distribution(reviews),
        "ReviewVolume": metrics.monthly_trend(reviews),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")


def export_snapshot(tables: dict[str, DataFrame], out_dir: str) -> None:
    """Write each directory or catalog in its fixed order (see SNAPSHOT_ORDER); other tables in their own."""
    for name, df in tables.items():
        order = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_first(c) for c in SNAPSHOT_ORDER.get(name, [])]
        (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(f"{out_dir}/{name}")


def canonical_key(col: str) -> Column:
    """A review key as trimmed text without a fraction of zeros; null becomes empty."""
    return F.regexp_replace(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))), r"^(-?\d+)\.0+$", "$1")


def write_back_tags(source: DataFrame, tags: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The source rows with the tag columns of their review; tags without a row are appended.

    Keys are compared in canonical form; of source rows with one key the first by order (a column of distinct values)
    gets the tags. Tags have one row a key; blank values clear what was there. Rows without a key stay as they are.
    """
    missing = [c for c in columns if c not in source.columns]
    src = source.withColumns({c: F.lit(None).cast("string") for c in missing}).withColumn("_k", canonical_key(key))
    first = src.where("_k != ''").groupBy(F.col("_k").alias("_fk")).agg(F.min(order).alias("_order"))
    new = tags.select(canonical_key(key).alias("_nk"), *[blank_to_null(c).alias(f"_new_{c}") for c in columns]).where("_nk != ''")
    target = first.join(new, first["_fk"] == new["_nk"], "full_outer")  # tags with the place of their row, if any
    both = src.join(target, (src["_k"] == target["_fk"]) & (src[order] == target["_order"]), "full_outer").where("_k IS NOT NULL OR _nk IS NOT NULL")
    tagged = F.col("_nk").isNotNull()
    out = {c: F.when(tagged, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    out[key] = F.when(F.col("_k").isNull(), F.col("_nk").cast(source.schema[key].dataType)).otherwise(F.col(key))
    return both.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in [*source.columns, *missing]])
