"""The catalog cascade against a plain loop over the probes."""

import random

import pytest

from tallyvox.operators import products

CATALOG = "sku string, master_item string, brand string, category string, subcategory string, subsub_category string, region string, item_status string, lifecycle_phase string, description string"


def plain_match(row, catalog):
    clean = lambda x: (x or "").strip().upper()
    for column, kind, name in products.PROBES:
        own = clean(row.get(column))
        hits = [c for c in catalog if own and clean(c["sku" if kind == "sku_key" else "master_item"]) == own]
        if hits:
            best = min(hits, key=lambda c: [(c.get(f) is not None, c.get(f) or "") for f in ("brand", "category", "subcategory", "sku", "master_item", "description")])
            return name, own, best["brand"]
    return "unmatched", None, None


@pytest.mark.parametrize("columns", [("product_id", "sku_item", "base_sku"), ("product_id",), ("base_sku", "product_id")])
def test_the_first_probe_that_finds_a_row(spark, columns):
    rng = random.Random(len(columns))
    names = ["a1", "A1 ", "b2", "c3", "m1", "m2", " ", "", None, "zz"]
    catalog = [{"sku": rng.choice(names), "master_item": rng.choice(names), "brand": f"B{i % 4}", "description": f"d{i}"} for i in range(14)]
    rows = [{"review_id": f"r{i % 150}", **{c: rng.choice(names) for c in columns}} for i in range(200)] + [{"review_id": None, **dict.fromkeys(columns)}] * 3
    source = spark.createDataFrame([tuple(c.get(n.split()[0]) for n in CATALOG.split(", ")) for c in catalog], CATALOG)
    loaded = products._keys(source).withColumn("base_model_number", products.F.coalesce("master_item", "sku"))
    reviews = spark.createDataFrame([(r["review_id"], *[r[c] for c in columns]) for r in rows], "review_id string, " + ", ".join(f"{c} string" for c in columns))
    got = products.enrich_with_catalog(reviews, loaded).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["review_id"], *[r[c] for c in columns], r["match_type"], r["match_key"], r["mapped_brand"]) for r in got], key=key) == sorted([(r["review_id"], *[r[c] for c in columns], *plain_match(r, catalog)) for r in rows], key=key)
    assert all(r["mapping_detected"] == (r["match_type"] != "unmatched") for r in got)
    assert products.enrich_with_catalog(reviews, loaded.limit(0)).where("mapping_detected").count() == 0
    assert products.enrich_with_catalog(reviews.limit(0), loaded).count() == 0


def test_facets_in_one_pass(spark):
    """Each field by what the other fields' selections leave, against a loop over the fields."""
    rng = random.Random(9)
    rows = [(*(rng.choice(["a", "b", "c", None]) for _ in products.FACETS), rng.randint(1, 9)) for _ in range(300)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in products.FACETS) + ", row_count long")
    for selection in ({}, {"product_id": ["a", "b"]}, {"product_id": ["a"], "mapped_brand": ["b", "c"], "mapped_category": []}, {f: ["a", "c"] for f in products.FACETS}, {"mapped_brand": ["none"]}):
        want = {}
        for i, field in enumerate(products.FACETS):
            for r in rows:
                if all(r[j] in selection[f] for j, f in enumerate(products.FACETS) if f != field and selection.get(f)):
                    want[field, r[i]] = want.get((field, r[i]), 0) + r[-1]
        assert {(r["field"], r["value"]): r["review_count"] for r in products.facet_options(table, **selection).collect()} == want
    top = products.facet_options(table, 2).collect()
    assert len(top) == 2 * len(products.FACETS)
    plan = products.facet_options(table, product_id=["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_vendor_catalog_by_its_own_headers(spark):
    rows = [(" p1 ", "M1", "", "Thing", "Red", "new", "Sub"), ("p2", None, "B", None, None, "n", None), ("", " ", "B", "lost", None, None, None)]
    raw = spark.createDataFrame(rows, "`Product ID` string, `Model Code` string, Brand string, `Product Name` string, `Color Variant` string, Notes string, SubCategory string")
    got = {r["sku"]: r for r in products.load_vendor_catalog(raw, "House").collect()}
    assert list(got) == ["p1", "p2"]
    one, two = got["p1"], got["p2"]
    assert (one["sku_key"], one["master_item_key"], one["brand"], one["description"], one["item_long_description"], one["subcategory"], one["item_class"], one["base_model_number"]) == ("P1", "M1", "House", "Thing", "Thing · Red · new", "Sub", "Sub", "M1")
    assert (two["brand"], two["description"], two["item_long_description"], two["base_model_number"], two["ean"]) == ("B", None, "p2 · n", "p2", None)
    master = products.load_sku_catalog(spark.createDataFrame([("s", "x", "8")], "SKU string, `User Item Type` string, EAN string"))
    both = products.combine_catalogs(master, products.load_vendor_catalog(raw, "House"))
    found = products.enrich_with_catalog(spark.createDataFrame([("1", "S"), ("2", "P1")], "review_id string, product_id string"), both)
    assert {r["review_id"]: (r["mapped_ean"], r["mapped_user_item_type"], r["mapped_item_long_description"]) for r in found.collect()} == {"1": ("8", "x", None), "2": (None, None, "Thing · Red · new")}


def test_source_metadata_fills_blanks(spark):
    from tallyvox.sources.payloads import apply_source_metadata

    rows = spark.createDataFrame([("a", None), (" ", "u"), (None, "")], "retailer string, source_system string")
    got = [(r["retailer"], r["post_link"], r["source_system"]) for r in apply_source_metadata(rows, "Okendo", "Shop", "http://x").collect()]
    assert got == [("a", "http://x", "Okendo"), ("Shop", "http://x", "Okendo"), ("Shop", "http://x", "Okendo")]
