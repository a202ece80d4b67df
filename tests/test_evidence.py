from tallyvox.operators import evidence
from tallyvox.sources import exports


def test_pack_counts_reviews_not_mentions(spark):
    df = spark.createDataFrame([("It is LOUD, so  loud",), (None,), ("",), ("quiet",)], "review_text string")
    got = evidence.supported_pack(df, [("Loud", "detractor", ["so loud"]), ("Odd", "detractor", []), ("Calm", "delighter", ["quiet"])])
    assert {(r["label"], r["hits"]) for r in got.collect()} == {("Loud", 1), ("Calm", 1)}


def test_prune_catalog_by_counts_or_by_order(spark):
    catalog = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "label string, position int")
    tiers = lambda counts: {r["label"]: r["tier"] for r in evidence.prune_catalog(catalog, spark.createDataFrame(counts, "label string, n int"), max_labels=2).collect()}
    assert tiers([("c", 300)]) == {"a": "extended", "b": "extended", "c": "primary"}
    assert tiers([("c", 3)]) == {"a": "primary", "b": "primary", "c": "extended"}


def test_taxonomy_table(spark):
    df = spark.createDataFrame([(" Noise ", "Cons", "loud, noisy|"), ("Price", "pos", None), ("X", "other", "")], "Symptom string, Type string, Aliases string")
    got = {(r["side"], r["label"], tuple(r["aliases"])) for r in evidence.load_taxonomy(df).collect()}
    assert got == {("detractor", "Noise", ("loud", "noisy")), ("delighter", "Price", ())}


def test_watch_keeps_organic_reviews_of_selected_regions(spark):
    df = spark.createDataFrame([("Amazon", "United States", "2026-03-25", False, 5), ("Amazon", "United Kingdom", "2026-04-05", True, 2), ("Target", "United States", "2026-04-10", False, 4), ("Target", "United Kingdom", "2026-04-12", False, 3)], "Merchant string, Market string, day string, Sponsored boolean, rating int")
    rows = evidence.watch_rows(df, "Merchant", "Market", "day", "Sponsored", True, ["USA", "UK"])
    assert {(r["Retailer"], r["Region"], r["Reviews"]) for r in evidence.watch_table(rows).collect()} == {("Amazon", "USA", 1), ("Target", "USA", 1), ("Target", "UK", 1)}
    assert {r["Region"]: (r["reviews"], r["avg_rating"]) for r in evidence.watch_kpis(rows).collect()}["All selected"] == (3, 4.0)
    assert evidence.watch_trend(rows).count() == 3


def test_write_back_tags(spark):
    source = spark.createDataFrame([("12.0", 1, "old"), ("12", 2, "old"), (None, 3, "kept"), ("7", 4, "x")], "id string, n int, tag string")
    tags = spark.createDataFrame([("12", "new", "a"), ("7", " ", "b"), ("99", "far", "c")], "id string, tag string, extra string")
    got = {(r["id"], r["n"], r["tag"], r["extra"]) for r in exports.write_back_tags(source, tags, "id", "n", ["tag", "extra"]).collect()}
    assert got == {("12.0", 1, "new", "a"), ("12", 2, "old", None), (None, 3, "kept", None), ("7", 4, None, "b"), ("99", None, "far", "c")}


def test_signature_ignores_order_only(spark):
    rows, schema = [("a/x", "x", 1, 1.0), ("b/y", "y", 2, 2.0)], "relative_path string, name string, size long, mtime double"
    sign = lambda r: exports.source_signature(spark.createDataFrame(r, schema)).first()["signature"]
    assert sign(rows) == sign(rows[::-1]) != sign([rows[0], ("b/y", "y", 3, 2.0)])


def test_bundle_and_snapshot_read_back(spark, tmp_path):
    from tallyvox.plans.reviews import reviews

    rows = reviews(spark, "/root/testdata/sf0.001").limit(50)
    exports.export_bundle(rows, f"{tmp_path}/bundle")
    back = spark.read.parquet(f"{tmp_path}/bundle/Reviews")
    assert back.count() == 50 and back.columns[0] == "review_id" and set(back.columns) == set(rows.columns)
    base = spark.createDataFrame([("a", 1), ("b", 3)], "base_model_number string, review_count int")
    exports.export_snapshot({"base_models": base}, f"{tmp_path}/snapshot")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/snapshot/base_models").collect()} == {("a", 1), ("b", 3)}
