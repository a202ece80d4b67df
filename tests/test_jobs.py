"""Vendor files, the sync job, entity search, review context and the stratified sample, against plain Python."""

import math
import os

import pytest

from tallyvox.functions.context import review_context
from tallyvox.operators import products, rank, symptoms
from tallyvox.sources import sync, uploads


def write(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(text.encode(encoding))


def test_csv_encodings(spark, tmp_path):
    write(tmp_path / "a", "a.csv", "﻿Review ID,Review Text\n1,\"Olé, two\nlines\"\n")
    write(tmp_path / "b", "b.csv", "Review ID,Review Text\n1,Ol\xe9\n", "latin-1")
    for folder, want in (("a", "Olé, two\nlines"), ("b", "Olé")):
        row = uploads.read_review_csv(spark, str(tmp_path / folder)).first()
        assert (row["Review ID"], row["Review Text"], row["source_file"]) == ("1", want, f"{folder}.csv")


def test_vendor_files(spark, tmp_path):
    write(tmp_path / "v", "acme__P1.csv", "Review Text,Rating,Retailer\ngood,5,\nbad,1,Shop\n")
    write(tmp_path / "v", "other.csv", "Review Text,Rating,Retailer\nfine,4,\n")
    catalog = spark.createDataFrame([(" p1 ", "BM", None, "A Thing", None), ("P1", "ZZ", None, "Later", "X"), (None, "N", None, None, None)], "sku string, base_model_number string, master_item string, description string, brand string")
    got = {r["review_text"]: r for r in uploads.normalize_vendor_file_reviews(uploads.read_review_csv(spark, str(tmp_path / "v")), catalog, "Acme", "Acme").collect()}
    assert [(got[t]["review_id"], got[t]["product_id"], got[t]["base_sku"], got[t]["original_product_name"], got[t]["retailer"], got[t]["brand_raw"], got[t]["moderation_bucket"]) for t in ("good", "bad", "fine")] == [
        ("acme__p1__1", "p1", "BM", "A Thing", "Acme", "Acme", "Approved"), ("acme__p1__2", "p1", "BM", "A Thing", "Shop", "Acme", "Approved"), ("acme__other__1", "other", "other", "other", "Acme", "Acme", "Approved"),
    ]


def test_sync(spark, tmp_path):
    reviews, catalogs, out = (str(tmp_path / x) for x in ("reviews", "catalogs", "out"))
    write(reviews, "r.csv", "Review ID,Product ID,Review Text,Rating\n1,S1,a,5\n2,S2,b,1\n3,,c,2\n")
    write(catalogs, "c.csv", "SKU,Master Item,Brand,Category,SubCategory,SubsubCategory,REGION,Item Status,Lifecyle Phase,Description\ns1,M1,B,C,,,,,,d\n")
    with pytest.raises(ValueError):
        sync.read_synced(spark, out, "reviews")
    first = sync.sync_reviews(spark, reviews, catalogs, out)
    assert (first["skipped"], first["row_count"], first["mapped_count"], first["unmatched_count"]) == (False, 3, 1, 2)
    assert sync.sync_reviews(spark, reviews, catalogs, out)["skipped"]
    assert {r["review_id"]: r["match_type"] for r in sync.read_synced(spark, out, "reviews").collect()} == {"1": "product_to_sku", "2": "unmatched", "3": "unmatched"}
    write(reviews, "s.csv", "Review ID,Product ID,Review Text,Rating\n4,S1,d,5\n")
    again = sync.sync_reviews(spark, reviews, catalogs, out)
    assert not again["skipped"] and again["row_count"] == 4 and again["run"] != first["run"] and not sync.sync_reviews(spark, reviews, catalogs, out, force=True)["skipped"]
    assert sync.read_synced(spark, out, "base_models").count() == 3


def test_search(spark):
    models = spark.createDataFrame([("AB-100", "Acme", "Vacuum", None, 900, 4.0), ("CD200", "Zeta", "Vacuum", None, 10, 3.0)], "base_model_number string, mapped_brand string, mapped_category string, mapped_subcategory string, review_count long, avg_rating double")
    goods = spark.createDataFrame([("AB-100", "P1", "Quiet Vacuum", "Acme", "Vacuum", None, 500, 4.0), ("CD200", "P2", None, "Zeta", "Blender", None, 5, 3.0)], "base_model_number string, product_id string, original_product_name string, mapped_brand string, mapped_category string, mapped_subcategory string, review_count long, avg_rating double")
    rows = products.search_entities(models, goods, "ab100").collect()
    assert [(r["entity_type"], r["base_model_number"]) for r in rows[:2]] == [("Base model", "AB-100"), ("Product", "AB-100")] and rows[0]["score"] == 430 + 18 + 1.8
    assert [r["product_id"] for r in products.search_entities(models, goods, "quiet vacum", 1).collect()] == ["P1"]
    assert [r["base_model_number"] for r in products.search_entities(models, goods).collect()] == ["AB-100", "CD200"]
    assert products.search_entities(models.limit(0), goods.limit(0), "x").count() == 0


def test_context(spark):
    df = spark.createDataFrame([("Nice Good  thing", "Nice", "good thing", "Red", "red", "ab", "x" * 500, 5, ["a"]), (None,) * 9], "title_and_text string, title string, review_text string, color string, Shade string, short_note string, long_note string, rating int, list array<string>")
    got = [r["c"] for r in df.select(review_context(df).alias("c")).collect()]
    assert got == ["Nice Good thing\nTitle: Nice\nReview Text: good thing\nColor: Red\nLong Note: " + "x" * 400, ""]


def brute_sample(rows, n):
    words = lambda t: len(t.split())

    def count(words_, t):
        import re

        return len(re.findall(r"\b(?:" + "|".join(r"\s+".join(map(re.escape, w.split())) for w in words_) + r")\b", t.lower()))

    def priority(r):
        stars = 3.0 if r["rating"] is None else r["rating"]
        points = 4.0 if stars <= 2 else 2.5 if stars >= 4.5 else 1.2 if 2.5 <= stars <= 3.5 else 0.0
        t = r["text"]
        return points + min(words(t), 500) / 120 + min(count(rank.NEGATIVE, t), 4) * 0.9 + min(count(rank.POSITIVE, t), 4) * 0.45 + min(count(rank.MIXED, t), 2) * 0.9 + min(len(t), 1200) / 1500

    rows = [dict(r, p=priority(r), w=words(r["text"]), star=int(min(max(round(3.0 if r["rating"] is None else r["rating"]), 1), 5))) for r in rows if (r["text"] or "").strip()]
    if not rows:
        return []
    by_p = sorted(rows, key=lambda r: (-r["p"], r["id"]))
    taken = {}

    def extend(some, limit, stage):
        new = [r for r in some if r["id"] not in taken][: max(0, min(limit, n - len(taken)))]
        taken.update((r["id"], stage) for r in new)

    stars = sorted({r["star"] for r in rows})
    for s in stars:
        extend([r for r in by_p if r["star"] == s], max(1, math.ceil(n * 34 / (100 * len(stars)))), 0)
    lengths = sorted(r["w"] for r in rows)
    at = 0.75 * (len(lengths) - 1)
    long_at = lengths[int(at)] + (at - int(at)) * (lengths[min(int(at) + 1, len(lengths) - 1)] - lengths[int(at)]) if len(rows) >= 4 else lengths[-1]
    timed = any(r["at"] for r in rows)
    groups = [[r for r in by_p if count(rank.SIGNALS[k], r["text"])] for k in ("defects", "mixed", "maintenance")]
    if timed:
        groups.append(sorted([r for r in rows if r["at"]], key=lambda r: (-r["at"].timestamp(), -r["w"], r["id"])))
    groups += [[r for r in by_p if count(rank.SIGNALS["delight"], r["text"])], sorted([r for r in rows if r["w"] >= long_at], key=lambda r: (-r["w"], -r["p"], r["id"]))]
    for g in groups:
        extend(g, max(1, math.ceil(n / (2 * len(groups)))), 1)
    extend(by_p, n, 2)
    return list(taken.items())


@pytest.mark.parametrize("n", [1, 7, 25, 200])
def test_sample(spark, n):
    import datetime
    import random

    rng = random.Random(4)
    said = ["broken", "love", "but", "clean", "filter", "quiet", "slow", "wish", "motor", "box", "red", "leak", "doesn't", "hard to", "worth it", "table"]
    rows = [{"id": f"r{i:03}", "rating": rng.choice([1.0, 2.0, 4.0, 5.0, 4.5, None]), "text": " ".join(rng.choices(said, k=rng.randrange(0, 40))), "at": rng.choice([None, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(90))])} for i in range(120)]
    df = spark.createDataFrame([(r["id"], r["rating"], r["text"], r["at"]) for r in rows], "review_id string, rating double, title_and_text string, submission_time timestamp").selectExpr("*", "CAST(NULL AS INT) AS review_length_words")
    got = rank.sample_reviews(df.repartition(3), n).orderBy("position").collect()
    assert [(r["review_id"], r["stage"]) for r in got] == brute_sample(rows, n)
    assert rank.sample_reviews(df.limit(0), n).count() == 0


def test_impact_without_rows(spark):
    table = spark.createDataFrame([("Loud", 10, 2.0), ("Quiet", 5, None)], "label string, mentions long, avg_star double")
    got = {r["label"]: r for r in symptoms.symptom_impact_of_table(table, 100, 4.0).collect()}
    assert (got["Loud"]["net_hit"], got["Loud"]["forecast"], got["Loud"]["severity"]) == (-0.2, -0.154, 1.18) and got["Quiet"]["net_hit"] == 0
    assert [r["label"] for r in rank.opportunity_top(table, baseline=4.0).collect()] == ["Loud"]


def plain_score(row, query):
    """The points of a query for one directory row, by the rule: fields in order, the higher of before and tier, words in common, likeness."""
    from tallyvox.functions.wording import likeness

    text = " ".join(query.lower().split())
    squeeze = lambda x: "".join(c for c in x if c.isascii() and c.isalnum())
    words = lambda x: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in x).split()}
    score, key = 0.0, squeeze(text)
    for name in products.SEARCHED:
        value = (row[name] or "").strip().lower()
        if not value:
            continue
        code, own = name in products.CODES, squeeze(value)
        for how, fits, *points in products.TIERS:
            a, b = (value, text) if how == "written" else (own, key)
            if a and b and {"is": a == b, "starts": a.startswith(b), "holds": b in a}[fits]:
                score = max(score, points[not code])
        score += len(words(text) & words(value)) * products.WORD_POINTS[not code]
        ratio = likeness(key, own) if key and own else 0.0
        if ratio >= 0.72:
            score = max(score, 120 + ratio * (150 if code else 120))
        elif ratio >= 0.58:
            score = max(score, 70 + ratio * (100 if name in products.FAR_NAMES else 80))
    bonus = 18 if math.isfinite(score) and any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and row["entity_type"] == "Base model" else 0
    return score + bonus + min((row["review_count"] or 0) / 500, 18.0)


@pytest.mark.parametrize("query", ["AB-100", "ab100", "vacuum zeta", "quiet vacum", "x9 blend", "(%", "zz"])
def test_entity_scores_by_the_rule(spark, query):
    values = ["AB-100", "ab 100", "AB-1000", "X9", "Quiet Vacuum", "Zeta", "vacum", "Blender X9", "", None, "  ", "É zz", "100"]
    rows = [("Base model" if i % 2 else "Product", *[values[(i * k + k) % len(values)] for k in range(1, 7)], i * 700 if i % 5 else None) for i in range(60)]
    table = spark.createDataFrame(rows + rows[:2], "entity_type string, " + ", ".join(f"{c} string" for c in products.SEARCHED) + ", review_count long")
    got = products.entity_scores(table, query).collect()
    assert len(got) == 62
    for r in got:
        assert abs(r["score"] - plain_score(r, query)) < 1e-9, r
