import datetime as dt

from pyspark.sql import functions as F

from tallyvox.operators import audit
from tallyvox.streaming import streams, timed

TAGS = "key string, dets array<string>, dels array<string>, ev_det map<string,array<string>>, ev_del map<string,array<string>>"


def test_label_tracker_equals_the_batch_report(spark, tmp_path):
    """Over three runs with restarts: the standing alerts are the batch report's, and a batch says only what it changed."""
    catalog = spark.createDataFrame([("Loud", "detractor"), ("Quiet", "delighter"), ("Good", "delighter")], "label string, side string")
    land, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    steps = [[(["Loud"] if i % 2 else [], []) for i in range(30)], [([], ["Good"]) for _ in range(4)], [([], ["Quiet"] * (i == 0)) for i in range(60)]]
    rows, seen = [], []
    for step in steps:
        new = [(str(len(rows) + i), dets, dels, None, None) for i, (dets, dels) in enumerate(step)]
        rows += new
        spark.createDataFrame(new, TAGS).coalesce(1).write.mode("append").parquet(land)
        streams.stream_label_tracker(spark.readStream.schema(TAGS).parquet(land), catalog, out, log).awaitTermination()
        want = {tuple(r) for r in audit.label_alerts(spark.createDataFrame(rows, TAGS), catalog).collect()}
        assert {tuple(r) for r in streams.standing_alerts(spark, out).select("label", "side", "issue", "pct", "count").collect()} == want
        seen.append({(r["label"], r["issue"], r["change"]) for r in spark.read.parquet(f"{out}/changes").where(F.col("batch") == len(seen)).collect()})
    assert seen[0] == {("Loud", "too_broad", "new"), ("Quiet", "zero_hits", "new"), ("Good", "zero_hits", "new")}
    assert seen[1] == {("Loud", "too_broad", "ended"), ("Good", "zero_hits", "ended")} or ("Good", "zero_hits", "ended") in seen[1]
    assert ("Quiet", "zero_hits", "ended") in seen[2] and ("(overall)", "high_zero_rate", "new") in seen[2] and not any(c == "new" and label == "Loud" for label, _, c in seen[2])


def test_last_arrival_and_months_end(spark, tmp_path):
    """What the watermark has passed is given out once and its state dropped; the results are those of the batch."""
    spark.conf.set(*timed.STATE_STORE)
    try:
        start, schema = dt.datetime(2024, 1, 1), "_k string, ts timestamp, v double"
        rows = [(None if i % 11 == 10 else f"k{i % 7}", start + dt.timedelta(days=i), None if i % 5 == 0 else float(i)) for i in range(120)] + [("k0", None, 1.0)]
        land = str(tmp_path / "in")
        for part in (rows[:50], rows[50:90], rows[90:], [("late", start, 0.0)], [("end", dt.datetime(2025, 1, 1), 0.0)], [("end", dt.datetime(2026, 1, 1), 0.0)]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
        source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        got, total = {}, {}
        for name, df in (("months", timed.stream_months(source(), ["_k"], ["v"], "5 days", "ts")), ("last_rows", timed.stream_last(source(), ["_k"], ["ts"], 86_400 * 20, "ts"))):
            q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination()
            got[name] = sorted(map(tuple, spark.table(name).collect()), key=str)
            total[name] = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
        months, last = {}, {}
        for k, t, v in rows:
            if t:
                x = months.setdefault((k, t.replace(day=1)), [0.0, 0.0, 0.0])
                months[k, t.replace(day=1)] = [x[0] + 1, x[1] + (v or 0), x[2] + (v is not None)]
                last[k] = (k, t, v)
        months["end", dt.datetime(2025, 1, 1)] = [1.0, 0.0, 1.0]
        assert got["months"] == sorted([(*key, *x) for key, x in months.items()], key=str)
        assert [r for r in got["last_rows"] if r[0] not in ("end", "late")] == sorted(last.values(), key=str)
        assert total["months"] <= 2 and total["last_rows"] <= 1  # only the last row of all is open
    finally:
        spark.conf.unset(timed.STATE_STORE[0])


def test_reports_on_edge_rows(spark):
    rows = spark.createDataFrame([("1", None, None, None, None), ("2", ["A", "B", "C"], [], {x: ["the same long text"] for x in "ABC"}, None)], TAGS)
    assert [r["labels"] for r in audit.shared_evidence(rows).collect()] == [["A", "B", "C"]]
    stars = spark.createDataFrame([("1", 5.0, None), ("2", 5.0, "x")], "key string, rating double, review_text string")
    assert [(r["key"], r["issue"]) for r in audit.polarity_mismatches(rows, stars).collect()] == [("2", "5star_only_detractors")]
    assert {r["key"]: r["needs_verification"] for r in audit.flag_for_verification(rows, stars).collect()} == {"1": False, "2": True}
    empty = rows.limit(0)
    assert audit.tag_distribution(empty).count() == 0 and audit.label_alerts(empty, stars.select(F.col("key").alias("label"), F.lit("detractor").alias("side"))).count() == 0


def test_counts_of_reviews_that_say_the_same(spark):
    """Reports over rows that stand for several reviews give what they give over the reviews themselves."""
    kinds = [(3, ["Loud"], [], {"Loud": ["a b c"]}, {}), (2, ["Loud", "Bulky"], ["Quiet"], None, None), (1, [], [], {}, {}), (30, [], ["Quiet"], None, {"Quiet": ["x"]})]
    shape = "n int, dets array<string>, dels array<string>, ev_det map<string,array<string>>, ev_del map<string,array<string>>"
    few = spark.createDataFrame(kinds, shape)
    each = spark.createDataFrame([k for k in kinds for _ in range(k[0])], shape).drop("n").withColumn("key", F.monotonically_increasing_id().cast("string"))
    catalog = spark.createDataFrame([("Loud", "detractor"), ("Quiet", "delighter"), ("Never", "delighter")], "label string, side string")
    unlisted = lambda df: df.withColumns({"unl_dets": F.array(F.lit("odd")), "unl_dels": F.array().cast("array<string>")})
    for report in (audit.tag_distribution, audit.label_counts, lambda t: audit.label_alerts(t, catalog), lambda t: audit.calibration_report(t, catalog), lambda t: audit.taxonomy_recommendations(unlisted(t), catalog)):
        got, want = (sorted(tuple(r) for r in report(t).collect()) for t in (few, each))
        assert got == want and got
