"""Nested review payloads of three vendors as flat review rows; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import blank_to_null, clean

_BV = "Id:string, ProductId:string, OriginalProductName:string, Title:string, ReviewText:string, Rating:double, IsRecommended:boolean, UserNickname:string, AuthorId:string, UserLocation:string, ContentLocale:string, SubmissionTime:string, ModerationStatus:string, CampaignId:string, SourceClient:string, IsFeatured:boolean, IsSyndicated:boolean, SyndicationSource:struct<Name:string>, IsRatingsOnly:boolean, TotalPositiveFeedbackCount:double, BadgesOrder:array<string>, ContextDataValues:map<string,struct<Value:string,Label:string>>, Photos:array<struct<Sizes:map<string,struct<Url:string>>>>"
_SAME = "headline:string, comments:string, bottom_line:string, nickname:string, location:string, locale:string, created_date:long"
_PR = f"review_id:string, ugc_id:string, internal_review_id:string, legacy_id:string, page_id:string, author_id:string, status:string, is_syndicated:boolean, {_SAME}, details:struct<product_page_id:string, rating:double, properties:string, {_SAME}>, metrics:struct<rating:double, helpful_votes:double>, media:array<map<string,string>>, badges:map<string,boolean>"
_OK = "reviewId:string, id:string, productId:string, variantId:string, productUrl:string, productName:string, title:string, body:string, rating:double, isRecommended:boolean, subscriberId:string, languageCode:string, dateCreated:string, dateSubmitted:string, status:string, isFeatured:boolean, isIncentivized:boolean, syndicatedFromSubscriberId:string, helpfulCount:double, media:array<map<string,string>>, reviewMedia:array<map<string,string>>, mediaItems:array<map<string,string>>, reviewer:struct<displayName:string, isVerified:boolean, location:struct<country:struct<name:string, code:string>>, attributes:array<struct<title:string, type:string, value:string>>>"
#: For each vendor the schema of a page and the expression of its reviews.
PAGES = {
    "bazaarvoice": (f"Results array<struct<{_BV}>>", "Results"),
    "powerreviews": (f"results array<struct<reviews:array<struct<{_PR}>>, {_PR}>>", None),
    "okendo": (f"reviews array<struct<{_OK}>>", "reviews"),
}
#: Picture sizes and link fields in the order in which they are tried.
PHOTO_SIZES = ["large", "normal", "thumbnail"]
POWER_LINKS = ["large_url", "normal_url", "thumbnail_url", "url", "fullsize_url", "media_url", "src", "link"]
OKENDO_LINKS = ["url", "src", "fullsizeUrl", "fullsize_url", "largeUrl", "large_url", "thumbnailUrl", "thumbnail_url", "mediaUrl", "media_url"]
INCENTIVE_BADGES = "sampling|sample|sweepstakes|incentivized|influencer"
NO_AGE = ["", "nan", "none", "null", "unknown", "prefer not to say"]


def read_review_json(spark: SparkSession, path: str, vendor: str) -> DataFrame:
    """One row for each review of the vendor's JSON pages, with the vendor's fields; pages without reviews give none."""
    schema, reviews = PAGES[vendor]
    pages = spark.read.schema(schema).option("multiLine", True).json(path)
    if reviews:
        return pages.select(F.inline(reviews))
    result = pages.select(F.explode("results").alias("r"))
    names = [f.name for f in result.schema["r"].dataType.fields if f.name != "reviews"]
    single = F.array(F.struct(*[F.col(f"r.{n}").alias(n) for n in names]))
    held = F.when(F.size("r.reviews") > 0, F.col("r.reviews")).when(F.coalesce("r.review_id", "r.ugc_id", "r.internal_review_id", "r.legacy_id").isNotNull(), single)
    return result.select(F.inline(held))


def _links(media: Column, fields: list[str]) -> Column:
    """The first field of each item that holds a link."""
    return F.array_compact(F.transform(F.coalesce(media, F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(f)), F.lit("")) for f in fields])))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def flatten_bv(df: DataFrame) -> DataFrame:
    """Rows with badges, context and photo sizes: the largest link of each photo; incentivised by a badge or a context entry of that name."""
    photos = F.coalesce("Photos", F.array().cast(df.schema["Photos"].dataType))
    url = lambda p, size: F.nullif(F.try_element_at(p["Sizes"], F.lit(size))["Url"], F.lit(""))
    urls = F.array_compact(F.transform(photos, lambda p: F.coalesce(*[url(p, s) for s in PHOTO_SIZES])))
    badge = F.exists("BadgesOrder", lambda b: F.lower(b).contains("incentivized"))
    entry = F.exists(F.map_entries("ContextDataValues"), lambda e: F.lower(e["key"]).contains("incentivized") & F.lower(clean(e["value"]["Value"])).isin("", "true", "1", "yes"))
    return df.select(
        F.col("Id").alias("review_id"), F.col("ProductId").alias("product_id"), F.col("OriginalProductName").alias("original_product_name"), clean("Title").alias("title"), clean("ReviewText").alias("review_text"), F.col("Rating").alias("rating"),
        F.col("IsRecommended").alias("is_recommended"), F.col("UserNickname").alias("user_nickname"), F.col("AuthorId").alias("author_id"), F.col("UserLocation").alias("user_location"), F.col("ContentLocale").alias("content_locale"), F.col("SubmissionTime").alias("submission_time"),
        F.col("ModerationStatus").alias("moderation_status"), F.col("CampaignId").alias("campaign_id"), F.col("SourceClient").alias("source_client"), F.col("IsFeatured").alias("is_featured"), F.col("IsSyndicated").alias("is_syndicated"), F.col("SyndicationSource.Name").alias("syndication_source_name"),
        F.col("IsRatingsOnly").alias("is_ratings_only"), F.col("TotalPositiveFeedbackCount").alias("total_positive_feedback_count"), F.concat_ws(", ", "BadgesOrder").alias("badges"), F.coalesce(F.to_json("ContextDataValues"), F.lit("{}")).alias("context_data_json"),
        F.size(photos).alias("photos_count"), F.array_join(urls, " | ").alias("photo_urls"), (_yes(badge) | _yes(entry)).alias("incentivized_review"),
    )


def flatten_powerreviews(df: DataFrame, page_id: str = "", product_name: str = "", retailer: str = "", product_url: str = "") -> DataFrame:
    """Rows whose fields stand in details or at the top; times in epoch milliseconds; incentivised by a badge that is set."""
    either = lambda c: F.coalesce(blank_to_null(f"details.{c}"), blank_to_null(c), F.lit(""))
    product = F.coalesce(blank_to_null("details.product_page_id"), blank_to_null("page_id"), F.lit(page_id))
    links = _links(F.col("media"), POWER_LINKS)
    badges = F.map_keys(F.map_filter("badges", lambda _, v: _yes(v)))
    line = F.lower(either("bottom_line"))
    return df.select(
        F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("review_id", "ugc_id", "internal_review_id", "legacy_id")]).alias("review_id"), product.alias("product_id"), product.alias("base_sku"), product.alias("sku_item"), F.lit(product_name).alias("original_product_name"),
        either("headline").alias("title"), either("comments").alias("review_text"), F.coalesce("metrics.rating", "details.rating").alias("rating"), F.when(line.isin("yes", "recommended", "true"), True).when(line.isin("no", "false", "not recommended"), False).alias("is_recommended"),
        either("nickname").alias("user_nickname"), "author_id", either("location").alias("user_location"), either("locale").alias("content_locale"), F.timestamp_millis(F.coalesce("details.created_date", "created_date")).alias("submission_time"), F.nullif("status", F.lit("")).alias("moderation_status"),
        (_yes(F.col("is_syndicated")) | _yes(F.try_element_at("badges", F.lit("is_syndicated")))).alias("is_syndicated"), F.lit(False).alias("is_ratings_only"), F.col("metrics.helpful_votes").alias("total_positive_feedback_count"), F.concat_ws(", ", badges).alias("badges"),
        F.coalesce("details.properties", F.lit("[]")).alias("context_data_json"), F.size(links).alias("photos_count"), F.array_join(links, " | ").alias("photo_urls"), _yes(F.exists(badges, lambda k: F.lower(k).rlike(INCENTIVE_BADGES))).alias("incentivized_review"),
        F.lit(retailer).alias("retailer"), F.lit(product_url).alias("post_link"), F.lit("PowerReviews").alias("source_system"),
    )


def flatten_okendo(df: DataFrame, product_id: str = "", product_name: str = "", retailer: str = "", product_url: str = "") -> DataFrame:
    """Rows with reviewer attributes: age group and location from them where the profile has none; links without a scheme get https."""
    some = lambda c, other: F.coalesce(blank_to_null(c), F.lit(other))
    attributes = F.col("reviewer.attributes")
    first = lambda test: F.try_element_at(F.filter(attributes, test), F.lit(1))["value"]
    place = first(lambda a: a["type"] == "location")
    location = F.coalesce(blank_to_null("reviewer.location.country.name"), blank_to_null(F.get_json_object(place, "$.countryName")), blank_to_null(F.get_json_object(place, "$.countryCode")), F.when(~place.startswith("{"), clean(place)), F.lit(""))
    age = blank_to_null(first(lambda a: F.lower(a["title"]).contains("age")))
    listed = F.array_join(F.filter(F.from_json(age, "array<string>"), lambda v: F.trim(v) != ""), ", ")
    named = F.filter(attributes, lambda a: clean(a["title"]) != "")
    context = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda a: clean(a["title"]))), lambda t: F.struct(t, F.struct(F.try_element_at(F.filter(named, lambda a: clean(a["title"]) == t), F.lit(-1))["value"].alias("Value")))))
    items = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in ("media", "reviewMedia", "mediaItems")])
    links = F.array_distinct(_links(items, OKENDO_LINKS))
    product, page, lent = some("productId", product_id), some("productUrl", product_url), blank_to_null("syndicatedFromSubscriberId")
    return df.select(
        F.coalesce("reviewId", "id").alias("review_id"), product.alias("product_id"), product.alias("base_sku"), F.coalesce(blank_to_null("variantId"), product).alias("sku_item"), some("productName", product_name).alias("original_product_name"), clean("title").alias("title"), clean("body").alias("review_text"),
        "rating", F.col("isRecommended").alias("is_recommended"), clean("reviewer.displayName").alias("user_nickname"), F.col("subscriberId").alias("author_id"), location.alias("user_location"), clean("languageCode").alias("content_locale"), F.coalesce(blank_to_null("dateCreated"), F.col("dateSubmitted")).alias("submission_time"),
        F.nullif("status", F.lit("")).alias("moderation_status"), F.lit("Okendo").alias("source_client"), F.col("isFeatured").alias("is_featured"), lent.isNotNull().alias("is_syndicated"), lent.alias("syndication_source_name"), F.lit(False).alias("is_ratings_only"), F.col("helpfulCount").alias("total_positive_feedback_count"),
        F.concat_ws(", ", F.when(_yes(F.col("reviewer.isVerified")), "verified"), F.when(_yes(F.col("isIncentivized")), "incentivized"), F.when(lent.isNotNull(), "syndicated")).alias("badges"), F.coalesce(F.to_json(context), F.lit("{}")).alias("context_data_json"), F.size(links).alias("photos_count"), F.array_join(links, " | ").alias("photo_urls"),
        _yes(F.col("isIncentivized")).alias("incentivized_review"), F.lit(retailer).alias("retailer"), F.when(page.startswith("//"), F.concat(F.lit("https:"), page)).otherwise(page).alias("post_link"), F.lit("Okendo").alias("source_system"), F.coalesce(F.when(age.startswith("["), listed), age).alias("age_group"),
    )


def extract_age_group(context_json: Column | str) -> Column:
    """The first context entry whose name holds age and whose Value, Label or plain value says something."""
    entries = F.map_entries(F.from_json(context_json, "map<string,string>"))
    held = lambda v: clean(F.when(v.startswith("{"), F.coalesce(F.nullif(F.get_json_object(v, "$.Value"), F.lit("")), F.get_json_object(v, "$.Label"))).otherwise(v))
    values = F.transform(F.filter(entries, lambda e: F.lower(e["key"]).contains("age")), lambda e: held(e["value"]))
    return F.try_element_at(F.filter(values, lambda v: ~F.lower(v).isin(NO_AGE)), F.lit(1))


def apply_source_metadata(df: DataFrame, source_system: str, retailer: str = "", post_link: str = "") -> DataFrame:
    """Retailer and link where they are blank; the system always."""
    fill = lambda c, v: F.coalesce(blank_to_null(c), F.lit(v)) if c in df.columns else F.lit(v)
    return df.withColumns({"retailer": fill("retailer", retailer), "post_link": fill("post_link", post_link), "source_system": F.lit(source_system)})
