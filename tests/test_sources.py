import json

from pyspark.sql import functions as F

from tallyvox.sources import payloads, uploads


def test_okendo_payload(spark, tmp_path):
    page = {"reviews": [{"reviewId": "r1", "productId": "p", "productUrl": "//shop/x", "title": "T", "body": "B", "rating": 5, "isIncentivized": True, "reviewer": {"displayName": "A", "isVerified": True, "location": {"country": {"name": "United Kingdom"}}, "attributes": [{"title": "Age Range", "value": "35-44"}]}}, {"reviewId": "r2", "reviewer": {"attributes": [{"title": "Home", "type": "location", "value": {"countryCode": "US"}}]}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    one, two = payloads.flatten_okendo(payloads.read_review_json(spark, str(tmp_path / "p.json"), "okendo"), product_name="N").orderBy("review_id").collect()
    assert (one["post_link"], one["age_group"], one["user_location"], one["badges"], one["incentivized_review"]) == ("https://shop/x", "35-44", "United Kingdom", "verified, incentivized", True)
    assert json.loads(one["context_data_json"]) == {"Age Range": {"Value": "35-44"}}
    assert (two["user_location"], two["original_product_name"], two["photos_count"], two["rating"]) == ("US", "N", 0, None)


def test_other_payloads(spark, tmp_path):
    bv = {"Results": [{"Id": "1", "Rating": 4, "BadgesOrder": ["incentivizedReview"], "Photos": [{"Sizes": {"normal": {"Url": "n"}, "thumbnail": {"Url": "t"}}}]}, {"Id": "2", "ContextDataValues": {"IncentivizedReview": {"Value": "true"}, "Age": {"Value": "25"}}}, {"Id": "3"}]}
    (tmp_path / "b.json").write_text(json.dumps(bv))
    rows = payloads.flatten_bv(payloads.read_review_json(spark, str(tmp_path / "b.json"), "bazaarvoice")).withColumn("age", payloads.extract_age_group("context_data_json")).orderBy("review_id").collect()
    assert [(r["incentivized_review"], r["photo_urls"], r["age"]) for r in rows] == [(True, "n", None), (True, "", "25"), (False, "", None)]
    pr = {"results": [{"reviews": [{"ugc_id": "u", "details": {"headline": "H", "bottom_line": "Yes", "created_date": 0}, "metrics": {"rating": 3}, "badges": {"product_sampling": True, "x": False}, "media": [{"url": "m"}]}]}, {"review_id": "v", "headline": "G"}, {"page_id": "none"}]}
    (tmp_path / "p.json").write_text(json.dumps(pr))
    rows = payloads.flatten_powerreviews(payloads.read_review_json(spark, str(tmp_path / "p.json"), "powerreviews")).orderBy("review_id").collect()
    assert [(r["review_id"], r["title"], r["is_recommended"], r["incentivized_review"], r["photo_urls"]) for r in rows] == [("u", "H", True, True, "m"), ("v", "G", None, False, "")]


def test_uploaded_headers(spark):
    raw = spark.createDataFrame([("7", "fine", "bad", "Organic", "Loud", "c9"), (None, "good  stuff", "5", "Seeded", None, None), (None, "good  stuff", "5", "Seeded", None, None)], "`Verbatim Id` string, Verbatim string, `Star Rating` string, `Seeded Flag` string, `Symptom 1` string, `Case ID` string")
    rows = uploads.normalize_reviews(raw, "f.csv")
    got = rows.orderBy("review_text", "review_id").collect()
    assert (got[0]["review_id"], got[0]["rating"], got[0]["review_origin_group"], got[0]["Case ID"], got[0]["source_file"]) == ("7", None, "Organic", "c9", "f.csv")
    assert got[1]["review_id"].startswith("review_") and got[1]["review_id"] != got[2]["review_id"] and got[1]["rating_label"] == "5 star" and got[1]["review_length_words"] == 2
    assert "Symptom 1" not in rows.columns and "Symptom 1" in uploads.normalize_reviews(raw, include_tags=True).columns
    twice = spark.createDataFrame([("", "b")], ["x", "y"]).toDF("R", "R")
    assert uploads.collapse_duplicate_columns(twice).collect()[0]["R"] == "b"
    assert uploads.normalize_reviews(raw.limit(0)).where(F.lit(True)).count() == 0
