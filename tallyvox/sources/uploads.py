"""Uploaded review tables: reading, alias headers and the normal form of a review row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from .csv_files import read_csv_files

#: For each column the headers that stand for it, in the order in which they are tried.
ALIASES = {
    "review_id": ["Event Id", "Event ID", "Review ID", "Review Id", "Verbatim Id", "Verbatim ID", "Id", "review_id"],
    "product_id": ["Product ID", "Product Id", "ProductId", "Model (SKU)", "Model SKU", "Base SKU", "BaseSKU"],
    "base_sku": ["Base SKU", "Model (SKU)", "Model SKU", "BaseSKU"],
    "sku_item": ["SKU Item", "Model (SKU)", "Model SKU", "SKU", "Child SKU", "Variant SKU", "Item Number", "Item No"],
    "original_product_name": ["Product Name", "Product", "Name"],
    "review_text": ["Review Text", "Review", "Verbatim", "Body", "Content", "review_text"],
    "title": ["Title", "Review Title", "Review title", "Headline", "title"],
    "post_link": ["Post Link", "Web Link", "URL", "Review URL", "Product URL", "Product Page URL"],
    "rating": ["Overall Rating", "Rating (num)", "Rating", "Stars", "Star Rating", "rating"],
    "submission_time": ["Review Submission Date", "Opened date", "Opened Date", "Submission Time", "Review Date", "Date", "submission_time"],
    "content_locale": ["Review Display Locale", "Content Locale", "Locale", "Reviewer Location", "Location", "Country"],
    "retailer": ["Retailer", "Merchant", "Channel", "Source"],
    "age_group": ["Age Group", "Age", "Age Range", "Age (CDV)"],
    "user_location": ["Reviewer Location", "Location", "Country"],
    "country": ["Country", "Country Code"],
    "user_nickname": ["Reviewer Display Name", "Reviewer Name", "Display Name", "Nickname"],
    "total_positive_feedback_count": ["# Helpful Votes", "Helpful Votes", "Total Positive Feedback Count"],
    "is_recommended": ["Recommend to a Friend (Y/N)", "Is Recommended", "Recommend", "Recommended"],
    "photos_count": ["Photos", "Photo Count", "Photos Count"],
    "campaign_id": ["Campaign ID", "CampaignId", "Campaign"],
    "moderation_status": ["Moderation Status", "ModerationStatus", "Status"],
    "brand_raw": ["Brand"],
    "category_hierarchy": ["Category Hierarchy"],
    "verified_purchaser": ["VerifiedPurchaser (CDV)", "Verified Purchaser", "Verified", "verification", "Verification"],
    "incentivized_review": ["Seeded Flag", "Seeded", "Incentivized", "IncentivizedReview (CDV)", "Incentivized Review", "IncentivizedReview", "Gifted", "Gifted Flag"],
    "is_syndicated": ["Syndicated Flag", "Syndicated", "Syndicated Review", "Is Syndicated"],
}
#: Terms that mean yes and no, by flag.
_YES, _NO = ["yes", "true", "1", "t", "y"], ["no", "false", "0", "f", "n"]
FLAGS = {
    "incentivized_review": (["seeded", "incentivized", "gifted", "sampled", "sampling", "sponsored", "paid", *_YES], ["organic", "organic standard", "organic / standard", "earned", "unpaid", "not seeded", "not incentivized", "not gifted", "no incentive", "no incentives", "standard", *_NO]),
    "is_syndicated": (["syndicated", *_YES], ["not syndicated", *_NO]),
    "is_recommended": (["recommended", *_YES], ["not recommended", *_NO]),
    "verified_purchaser": (["verified", *_YES], _NO),
}
SLOT = r"(?i)^(ai )?symptom( (detractor|delighter))? \d+$"


def read_review_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Review files, each read by its own header and encoding and united by column name; see csv_files.read_csv_files."""
    return read_csv_files(spark, path, encoding)


def normalize_vendor_file_reviews(df: DataFrame, catalog: DataFrame, vendor: str, default_brand: str) -> DataFrame:
    """Review rows from a vendor's files (with source_file and _ord), one product a file: its id is what follows two underscores in the file's name.

    Names, base model and brand come from the catalog (sku, base_model_number, master_item, description, brand), else
    from the id and default_brand; retailer and source are the vendor, and reviews are approved where nothing else is
    said. Rows without an id are vendor__product__number, counted within a file in the order of _ord. Only the
    catalog's first row for a product counts.
    """
    stem = F.regexp_replace(F.col("source_file"), r"\.[^.]*$", "")
    marked = F.lower(stem).startswith(f"{vendor.lower()}__")
    rows = df.withColumn("_pid", F.lower(F.trim(F.when(marked, F.regexp_replace(stem, r"(?s)^.*?__", "")).otherwise(stem))))
    order = [F.asc_nulls_last(c) for c in ("base_model_number", "description") if c in catalog.columns]
    named = catalog.withColumn("_pid", F.lower(F.trim("sku"))).where("_pid != ''").withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order))).where("_rn = 1")
    of = lambda *cols: F.coalesce(*[L.blank_to_null(c) for c in cols if c in catalog.columns], F.lit(None).cast("string"))
    named = named.select("_pid", of("base_model_number", "master_item").alias("_base"), of("description").alias("_name"), of("brand").alias("_brand"))
    rows = rows.join(named, "_pid", "left")
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("_ord"))
    given = {
        "Product ID": F.col("_pid"), "Base SKU": F.coalesce("_base", "_pid"), "SKU Item": F.col("_pid"), "Product Name": F.coalesce("_name", "_pid"), "Brand": F.coalesce("_brand", F.lit(default_brand)),
        "Retailer": F.lit(vendor), "Source": F.lit(vendor), "Moderation Status": F.lit("APPROVED"),
    }
    headers = {c.strip().lower(): c for c in df.columns}
    fill = {headers.get(h.lower(), h): F.coalesce(L.blank_to_null(F.col(f"`{headers[h.lower()]}`")), v) if h.lower() in headers else v for h, v in given.items()}
    if "review id" not in headers:
        fill["Review ID"] = F.concat_ws("__", F.lit(vendor.lower()), "_pid", number.cast("string"))
    out = normalize_reviews(rows.withColumns(fill).drop("_pid", "_base", "_name", "_brand", "_ord"))
    return out.withColumn("source_system", F.lit(f"{vendor} uploaded file"))


def collapse_duplicate_columns(df: DataFrame) -> DataFrame:
    """Columns of the same name become one: the first value from the left that is not blank. Other columns stay as they are."""
    names = [c.strip() for c in df.columns]
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {n: [i for i, m in enumerate(names) if m == n] for n in names}
    pick = lambda ids: F.col(f"_c{ids[0]}") if len(ids) == 1 else F.coalesce(*[L.blank_to_null(F.col(f"_c{i}").cast("string")) for i in ids])
    return flat.select(*[pick(ids).alias(n) for n, ids in at.items()])


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> dict[str, Column]:
    """For each target the first alias among the headers, whatever their case; null text where there is none."""
    known = {c.strip().lower(): c for c in df.columns}
    found = {t: next((known[a.strip().lower()] for a in names if a.strip().lower() in known), None) for t, names in aliases.items()}
    return {t: F.col(f"`{c}`") if c else F.lit(None).cast("string") for t, c in found.items()}


def normalize_reviews(df: DataFrame, source_name: str = "", include_tags: bool = False) -> DataFrame:
    """An uploaded table as review rows; headers without an alias are carried through, symptom slots only if include_tags."""
    rows = collapse_duplicate_columns(df)
    cols = resolve_aliases(rows, ALIASES)
    cols |= {c: L.parse_flag(cols[c].cast("string"), *terms) for c, terms in FLAGS.items()}
    cols["photos_count"] = F.coalesce(cols["photos_count"].try_cast("double"), F.lit(0.0))
    cols["total_positive_feedback_count"] = cols["total_positive_feedback_count"].try_cast("double")
    cols |= {"source_file": F.lit(source_name or None).cast("string") if source_name or "source_file" not in rows.columns else F.col("source_file"), "source_system": F.lit("Uploaded file")}
    slots = [c for c in rows.columns if _slot(c)]
    extra = [c for c in rows.columns if c.lower() not in cols and c not in slots]
    tags = [L.clean_symptom(F.col(f"`{c}`").cast("string")).alias(c) for c in slots] if include_tags else []
    return finalize_reviews(rows.select(*[v.alias(k) for k, v in cols.items()], *tags, *[F.col(f"`{c}`") for c in extra]))


def _slot(name: str) -> bool:
    import re

    return re.match(SLOT, name.strip()) is not None


def finalize_reviews(df: DataFrame) -> DataFrame:
    """Types, lengths, labels and provenance of review rows; rows without an id get one from their content.

    Such an id is a hash of the content and its number among rows of the same content, so it does not depend on the
    order of rows. Only rows without an id are shuffled for that.
    """
    text = lambda c: L.clean(F.col(c).cast("string")) if c in df.columns else F.lit("")
    flag = lambda c: F.col(c).cast("boolean") if c in df.columns else F.lit(None).cast("boolean")
    stamp = F.col("submission_time").cast("string") if "submission_time" in df.columns else F.lit(None).cast("string")
    when = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(f)) if f else stamp.try_cast("timestamp") for f in (None, "M/d/yyyy", "M/d/yyyy H:mm")])
    body = text("review_text")
    rows = df.withColumns({"review_id": L.blank_to_null(text("review_id")), "title": text("title"), "review_text": body, "rating": (F.col("rating") if "rating" in df.columns else F.lit(None)).cast("string").try_cast("double"), "submission_time": when})
    rows = rows.withColumns({
        "title_and_text": F.trim(F.concat_ws(" ", "title", "review_text")), "review_length_chars": F.length("review_text"), "review_length_words": F.when(F.col("review_text") == "", 0).otherwise(F.size(F.split("review_text", r"\s+"))),
        "rating_label": F.coalesce(F.concat(F.col("rating").cast("int").cast("string"), F.lit(" star")), F.lit("Unknown")), "moderation_bucket": L.moderation_bucket(text("moderation_status")),
        "review_origin_group": L.origin_group(flag("incentivized_review"), flag("is_syndicated"), text("campaign_id")), "review_acquisition_channel": L.acquisition_channel(flag("incentivized_review"), text("campaign_id")),
    })
    content = F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_file", "product_id", "base_sku", "submission_time", "title", "review_text") if c in rows.columns]))
    bare = rows.where("review_id IS NULL").withColumn("_content", content)
    number = F.row_number().over(Window.partitionBy("_content").orderBy("rating"))
    named = bare.withColumn("review_id", F.concat(F.lit("review_"), F.substring(F.sha1(F.concat_ws("|", "_content", number.cast("string"))), 1, 16))).drop("_content")
    return rows.where("review_id IS NOT NULL").unionByName(named)
