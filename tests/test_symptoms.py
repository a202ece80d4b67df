from tallyvox.operators import symptoms as S
from tallyvox.operators import action, merge, products


def test_impact_matches_worked_numbers(spark):
    df = spark.createDataFrame([(1.0, "Noise", "Price"), (1.0, "Noise", "<NA>"), (4.0, "Price", None)], "rating double, d1 string, d2 string")
    rows = {r["label"]: r for r in S.symptom_impact(df, ["d1", "d2"], "detractors", baseline=4.0).collect()}
    assert (rows["Noise"]["net_hit"], rows["Noise"]["forecast"], rows["Noise"]["avg_tags"]) == (-1.5, -0.671, 1.5)
    assert (rows["Price"]["net_hit"], rows["Price"]["forecast"], rows["Price"]["pct_tagged"]) == (-0.5, -0.224, 66.7)


def test_overall_labels_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(1.0, "Noise"), (2.0, "Overall Dissatisfaction")], "rating double, d1 string")
    assert [(r["label"], r["pct_tagged"]) for r in S.symptom_table(df, ["d1"]).collect()] == [("Noise", 50.0)]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "rating double, d1 string, submission_time timestamp, review_id string")
    assert S.symptom_table(df, ["d1"]).count() == 0
    assert action.alert_feed(action.prepare_action_frame(df)).count() == 0


def test_upsert_and_suffixes(spark):
    old = spark.createDataFrame([("a", "p", "x", 1), ("b", "p", "y", 2)], "review_id string, product_id string, review_text string, n int")
    new = spark.createDataFrame([("a", "q", "z", 3), ("a", "q", "z2", 4), ("c", "q", "w", 5)], old.schema)
    assert sorted(r["n"] for r in merge.upsert_reviews(old, new, ["n"]).collect()) == [2, 4, 5]
    assert sorted(r["review_id"] for r in merge.merge_sources([old, new], ["n"]).collect()) == ["a", "a (2)", "a (3)", "b", "c"]


def test_cascade_prefers_earlier_probes(spark):
    mapping = spark.createDataFrame([("S1", "M1", "B1"), ("S2", "S1", "B2")], "SKU string, `Master Item` string, Brand string")
    catalog = products.load_sku_catalog(mapping)
    reviews = spark.createDataFrame([("r1", " s1 ", ""), ("r2", "x", "m1"), ("r3", "", "")], "review_id string, product_id string, base_sku string")
    got = {r["review_id"]: (r["match_type"], r["mapped_brand"]) for r in products.enrich_with_catalog(reviews, catalog).collect()}
    assert got == {"r1": ("product_to_sku", "B1"), "r2": ("base_to_master", "B1"), "r3": ("unmatched", None)}


def test_wordings_are_worked_out_by_sets_of_slots_with_the_same_labels(spark):
    import re

    from pyspark.sql import functions as F

    from tallyvox.functions import labels as L
    from tallyvox.operators import symptoms

    phrases = [p for x in L.CANONICAL.values() for p in x]
    tree, every = re.compile("(?i)" + L.phrase_tree(phrases)), re.compile("(?i)" + L.any_phrase(phrases))
    texts = [w for p in phrases for w in (p, p[:-1], p + "s", "so " + p.upper() + "!", p.replace(" ", "  "), "x" + p)]
    assert [bool(tree.search(t)) for t in texts] == [bool(every.search(t)) for t in texts]
    odd = ["too  loud", "hard\tto clean", " easy to clean ", "doesn't fit", "größe", "LOUD", "a-b c", "loud\n", "", "éa b", "x  y"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    old = L.py_title(F.trim(F.regexp_replace("t", r"\s+", " ")))
    got = rows.select("t", L.canonicalize_label("t").alias("new"), old.alias("old")).collect()
    assert [r.new for r in got if not every.search(r.old)] == [r.old for r in got if not every.search(r.old)]
    slots = spark.createDataFrame([(1.0, "loud", None), (1.0, "loud", ""), (None, "too loud", "quiet"), (3.0, "Loud ", "bulky"), (5.0, "overall satisfaction", None)], "rating double, a string, b string")
    plan = symptoms._counted(slots, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # first by slots as they stand
    found = {r.label: (r.mentions, r.pct_tagged, r.avg_star, round(r.weighted_mentions, 6)) for r in symptoms.symptom_table(slots, ["a", "b"]).collect()}
    assert found == {"Loud": (4, 80.0, 5 / 3, 3.0), "Quiet": (1, 20.0, None, 0.5), "Wrong Size": (1, 20.0, 3.0, 0.5)}
