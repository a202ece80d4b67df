"""Steps whose tasks must not grow with the tables."""

import datetime
import random

import duckdb

from tallyvox.operators import action, audit
from tallyvox.plans import reports, reviews

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(reviews, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    parts = -(-lines // 500)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and reviews.parts_of(spark, SF, "lineitem") == parts
    out = reports.QUERIES["a31_candidates"](spark, SF)
    assert plan(out).count(f", {parts}\n") >= 4
    assert not any(c in x for x in plan(out).splitlines() if "Relation" not in x for c in ("p_name", "o_orderstatus"))  # no texts move
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(f"SELECT side, label, count, other_side, first_key FROM ({reports.ORACLE_SQL['a31_candidates']})").fetchall())


def test_candidates_count_a_key_once_in_any_number_of_parts(spark):
    said = [(f"k{i % 7}", side, label) for i in range(40) for side, label in (("detractor", "too  loud"), ("delighter", "Too Loud"), ("detractor", f"x{i % 3}"))] + [("k9", "detractor", ""), ("k9", "detractor", " TOO LOUD ")]
    rows = spark.createDataFrame(said, "key string, side string, label string")
    got = [[tuple(r) for r in audit.candidate_labels(rows, 3, parts).select("side", "label", "count", "other_side", "keys").collect()] for parts in (None, 1, 9)]
    assert got[0] == got[1] == got[2] and got[0][0] == ("detractor", "Too Loud", 8, 7, ["k0", "k1", "k2"])


def test_feed_counts_each_review_once_for_each_kind(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice([*values, None])
    rows = [(f"r{i}" if i % 9 else None, datetime.datetime(2024, rng.choice([1, 2, 3, 5, 6, 7, 9]), 3) if i % 11 else None, pick(1.0, 2.0, 4.0, 5.0) if i < 700 else None, pick("US", "FR"), pick("A", "B"), pick("c", "d"), pick("m", "n") if i < 900 else "late", i % 2 == 0) for i in range(1000)]
    df = action.prepare_action_frame(spark.createDataFrame(rows, "review_id string, submission_time timestamp, rating double, country string, mapped_brand string, mapped_category string, base_model_number string, incentivized_review boolean"))
    feed = action.alert_feed(df, 5)
    told = ["segment", "review_count", "avg_rating", "rating_delta", "low_star_share", "volume_delta_pct"]
    exact = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    want = [exact((kind, r[col] or "Unknown", r["mapped_brand"] or "Unknown", *[r[c] for c in told])) for kind, col in action.SPECS for r in action.summarize_dimension(df, ["mapped_brand", col], min_reviews=5).collect()]
    got = [exact(r) for r in feed.select("entity_kind", "entity_label", "brand", *told).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r[3] for r in got}) > 2
    kept = [x for x in plan(feed).splitlines() if "InMemoryRelation" in x]
    assert 0 < len(kept) <= 4 and all("review_id" not in x for x in kept)  # sums, not reviews
