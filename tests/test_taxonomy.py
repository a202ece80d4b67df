"""Standard wording, support, priorities, merges and categories, against counts worked out by hand."""

from tallyvox.operators import taxonomy


def test_standard_labels(spark):
    want = [
        ("Easy Cleanup", "delighter", "Easy To Clean"), ("too noisy", "detractor", "Loud"), ("  Great   Value ", "delighter", "Good Value"), ("Purple & Shiny", "delighter", "Purple And Shiny"), ("n/a", "detractor", ""), (None, "detractor", ""), ("", None, ""),
        ("Strange Usability", "detractor", "Strange Use"), ("would not recommend", "detractor", "Overall Dissatisfaction"), ("hard install", None, "Difficult Setup"),
    ]
    rows = spark.createDataFrame([(a, b) for a, b, _ in want] * 2, "label string, side string")
    assert sorted((r["label"] or "", r["standard"]) for r in taxonomy.standardize_labels(rows).collect()) == sorted([(a or "", c) for a, _, c in want] * 2)


def test_standard_labels_keep_their_sense():
    for label, side, want in [
        ("loud", None, "Loud"), ("Noisy", None, "Loud"), ("noise", None, "Loud"), ("Not Loud", None, "Quiet"), ("not noisy at all", None, "Quiet"), ("low noise", None, "Quiet"), ("Quiet", None, "Quiet"), ("loud", "detractor", "Loud"), ("loud", "delighter", "Loud"),
        ("not loud", "detractor", "Not Loud"), ("Not Quiet", None, "Not Quiet"), ("not intuitive", None, "Difficult To Use"), ("intuitive", None, "Easy To Use"), ("doesn't fit", None, "Wrong Size"), ("would recommend", None, "Overall Satisfaction"), ("would not recommend", None, "Overall Dissatisfaction"),
    ]:
        assert taxonomy.standard_label(label, side) == want, (label, side, taxonomy.standard_label(label, side))


def test_support_and_priorities(spark):
    texts = ["The motor is loud. It cleans well.", "A loud noise every day!", "quiet and small", None, "  ", "Cleans the rug well, battery dies."]
    reviews = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "review_id string, review_text string, label string").repartition(3)
    catalog = [("Loud Noise", "detractor", ["loud motor", "is loud"]), ("Battery Dies", "detractor", []), ("Cleans Well", "delighter", []), ("Never Said", "delighter", None)]
    got = {r["label"]: r for r in taxonomy.label_support(reviews, catalog).collect()}
    assert {k: r["review_hits"] for k, r in got.items()} == {"Loud Noise": 2, "Battery Dies": 1, "Cleans Well": 2, "Never Said": 0}
    assert got["Loud Noise"]["support_ratio"] == 0.5 and got["Loud Noise"]["score"] == round(2 + 0.5 + 0.24 + 0.1, 4)
    assert got["Loud Noise"]["examples"] == ["The motor is loud.", "A loud noise every day!"] and got["Never Said"]["examples"] == []
    candidates = spark.createDataFrame([("Loud Noise", "detractor", ["Din"]), ("Loud Noise", "detractor", ["Roar", "Din"]), ("Battery Dies", "detractor", None), ("Overpriced", "detractor", []), ("", "detractor", []), ("Cleans Well", "delighter", [])], "label string, side string, aliases array<string>")
    ranked = taxonomy.prioritize_labels(candidates, taxonomy.label_support(reviews, catalog), ["Battery Dies"]).orderBy("side", "rank").collect()
    assert [(r["label"], r["bucket"], r["aliases"]) for r in ranked] == [("Cleans Well", "Product Specific", []), ("Battery Dies", "Category Driver", []), ("Loud Noise", "Product Specific", ["Din", "Roar"])]
    few = taxonomy.prioritize_labels(candidates, taxonomy.label_support(reviews, catalog), [], min_hits=9)
    assert sorted(r["label"] for r in few.collect()) == ["Battery Dies", "Cleans Well", "Loud Noise"]
    assert taxonomy.label_support(reviews.limit(0), catalog).where("review_hits = 0 AND support_ratio = 0").count() == 4


def test_catalog_rows_and_merges(spark):
    raw = spark.createDataFrame([("too noisy", "detractor"), ("Excess Noise", "detractor"), ("Motor Whine", "detractor"), ("Motor Whining", "detractor"), ("easy clean", "delighter")], "label string, side string")
    catalog = taxonomy.canonical_catalog(raw)
    got = {(r["side"], r["label"]): r["aliases"] for r in catalog.collect()}
    assert list(got) == [("delighter", "Easy To Clean"), ("detractor", "Loud"), ("detractor", "Motor Whine"), ("detractor", "Motor Whining")]
    assert {"Too Noisy", "Excess Noise"} <= set(got["detractor", "Loud"]) and "Loud" not in got["detractor", "Loud"]
    support = taxonomy.label_support(spark.createDataFrame([("1", "a motor whining")], "review_id string, review_text string"), [("Motor Whining", "detractor", [])])
    rows = taxonomy.taxonomy_rows(catalog, support, ["Motor Whine"])
    assert [(r["theme"], r["label"], r["bucket"], r["review_hits"]) for r in rows.collect()] == [("Noise", "Loud", "Product Specific", 0), ("Product Specific", "Motor Whine", "Category Driver", 0), ("Product Specific", "Motor Whining", "Product Specific", 1), ("Cleaning & Care", "Easy To Clean", "Product Specific", 0)]
    merges = taxonomy.suggest_merges(rows).collect()
    assert [(r["keep"], r["merge"], r["keep_hits"]) for r in merges] == [("Motor Whining", "Motor Whine", 1)]
    labels = spark.createDataFrame([("detractor", 1, "Loud Motor"), ("detractor", 2, "Motor Loud"), ("detractor", 3, "Slow"), ("delighter", 1, "Loud Motor"), ("detractor", 4, " ")], "side string, position int, label string")
    assert sorted((r["side"], r["label"], r["aliases"]) for r in taxonomy.dedupe_labels(labels).collect()) == [("delighter", "Loud Motor", []), ("detractor", "Loud Motor", ["Motor Loud"]), ("detractor", "Slow", [])]


def test_categories(spark):
    reviews = spark.createDataFrame([("1", "Strong suction, and my blender is fine"), ("1", "the Dust  Bin is big"), ("2", "nothing"), ("3", None), ("4", "suction")], "product_id string, review_text string")
    descriptions = spark.createDataFrame([("4", "An air fryer"), ("9", "vacuum")], "product_id string, description string")
    got = {r["product_id"]: (r["category"], r["confidence"], r["signals"]) for r in taxonomy.infer_category(reviews, descriptions).collect()}
    assert got == {"1": ("vacuum", round(1.6 / 2.7, 2), ["suction", "dust bin"]), "2": ("general", 0.0, []), "3": ("general", 0.0, []), "4": ("kitchen", round(3.5 / 4.6, 2), ["air fryer"])}
    assert {r["product_id"]: r["category"] for r in taxonomy.infer_category(reviews).collect()}["4"] == "vacuum"
