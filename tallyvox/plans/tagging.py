"""Registered queries over tagging, matching, taxonomies, orders and directories, with SQL for the same result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import negation as N
from ..functions.context import review_context
from ..functions.wording import ENDINGS, stem
from ..operators import audit, evidence, filters, matching, merge, products, rank, symptoms, tagging, taxonomy
from .catalog import _LAB, _R, _T, Query, _sku_catalog, six
from .catalog import ORACLE_SQL as CATALOG_SQL
from .evidence import _WATCH, REGION, _watched
from .reports import _TAGS, counted_tags, tags
from .reviews import DEL_COLS, DELIGHTERS, DET_COLS, DETRACTORS, _pick, parts_of, review_texts, reviews, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: six(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


#: Sentences of reviews, each with the label that a reader would give it, by side.
SAID = [
    ("The motor is loud and it wakes everyone.", "Loud", None), ("There are no issues with noise.", None, "Quiet"), ("It is quiet, we love it.", None, "Quiet"), ("Sadly not as quiet as hoped.", "Loud", None),
    ("It is easy to clean after dinner.", None, "Easy To Clean"), ("It was hard to clean and dirty.", "Hard To Clean", None), ("The box is blue.", None, None),
]
CATALOG = [("Loud", "detractor", ["too loud"]), ("Hard To Clean", "detractor", []), ("Wrong Size", "detractor", []), ("Quiet", "delighter", []), ("Easy To Clean", "delighter", []), ("Fast Charging", "delighter", []), ("Good Value", "delighter", [])]
_SAID = _R.rstrip() + f""", k AS (SELECT review_id, rating, (split_part(review_id, '-', 3)::BIGINT + split_part(review_id, '-', 4)::BIGINT) % {len(SAID)} AS i FROM reviews)"""


def _said(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda n: F.split_part("review_id", F.lit("-"), F.lit(n)).cast("long")
    return reviews(spark, sf).select("review_id", _pick([s for s, _, _ in SAID], (part(3) + part(4)) % len(SAID)).alias("review_text"), "rating")


def _labels_sql(at: int) -> str:
    return "CASE i " + " ".join(f"WHEN {n} THEN " + (f"['{x[at]}']" if x[at] else "[]::VARCHAR[]") for n, x in enumerate(SAID)) + " END"


@query("x5_refined_tags", _SAID + f" SELECT review_id, {_labels_sql(1)} AS dets, {_labels_sql(2)} AS dels FROM k WHERE i < {len(SAID) - 1} OR rating = 1")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    rows = _said(spark, sf)
    wrong = rows.where("rating = 1").select("review_id", F.lit("detractor").alias("side"), F.lit("Wrong Size").alias("label"))
    return tagging.refine_tags(tagging.score_tags(rows, CATALOG), wrong, len(CATALOG)).select("review_id", "dets", "dels")


_SUPPORTED = [("Loud", "detractor", "motor is loud", True), ("Loud", "detractor", "motor noise", True), ("Quiet", "delighter", "the box", False), ("Easy To Clean", "delighter", "easy to clean", True)]


@query("x6_supported_evidence", _R + f"SELECT label, evidence, supported, count(*) AS n FROM (SELECT CASE length(review_id) % 4 {' '.join(f'''WHEN {i} THEN {{'label': '{a}', 'evidence': '{c}', 'supported': {str(d).lower()}}}''' for i, (a, _, c, d) in enumerate(_SUPPORTED))} END AS r FROM reviews) t, LATERAL (SELECT r.label AS label, r.evidence AS evidence, r.supported AS supported) GROUP BY ALL")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    i = F.length("review_id") % 4
    rows = reviews(spark, sf).select(*[_pick([x[at] for x in _SUPPORTED], i).alias(name) for at, name in enumerate(("label", "side", "evidence"))])
    return tagging.supported_evidence(rows, CATALOG).groupBy("label", "evidence", "supported").agg(F.count("*").alias("n"))


_RAW = "raw AS (SELECT det1 AS raw_label, 'detractor' AS side FROM reviews UNION ALL SELECT del1, 'delighter' FROM reviews)"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf)
    return rows.select(F.col(f"`{DET_COLS[0]}`").alias("raw_label"), F.lit("detractor").alias("side")).unionByName(rows.select(F.col(f"`{DEL_COLS[0]}`").alias("raw_label"), F.lit("delighter").alias("side")))


_MATCHED = "CASE raw_label " + " ".join(f"WHEN '{x}' THEN '{x.title()}'" for x in [*DETRACTORS, *DELIGHTERS] if x.title() in {c[0] for c in CATALOG}) + " WHEN 'too loud' THEN 'Loud' END"


@query("x7_match_labels", _R.rstrip() + f", {_RAW} SELECT raw_label, side, {_MATCHED} AS label, CASE WHEN raw_label = 'too loud' THEN 'alias' WHEN {_MATCHED} IS NOT NULL THEN 'exact' END AS how, count(*) AS n FROM raw GROUP BY ALL")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_labels(_raw(spark, sf), CATALOG).groupBy("raw_label", "side", "label", "how").agg(F.count("*").alias("n"))


_STANDARD = "CASE WHEN raw_label IS NULL OR raw_label IN ('Not Mentioned', '<none>') THEN CASE WHEN raw_label = '<none>' THEN '<None>' ELSE '' END WHEN raw_label = 'too loud' THEN 'Loud' ELSE array_to_string(list_transform(string_split(raw_label, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END"


@query("x13_standard_labels", _R.rstrip() + f", {_RAW} SELECT raw_label, side, {_STANDARD} AS standard, count(*) AS n FROM raw GROUP BY ALL")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.standardize_labels(_raw(spark, sf).withColumnRenamed("raw_label", "label")).groupBy(F.col("label").alias("raw_label"), "side", "standard").agg(F.count("*").alias("n"))


_THEME = "CASE WHEN label IN ('Loud', 'Quiet') THEN 'Noise' WHEN label LIKE '%Clean' THEN 'Cleaning & Care' WHEN label = 'Fast Charging' THEN 'Power & Battery' WHEN label = 'Wrong Size' THEN 'Size & Fit' WHEN label = 'Good Value' THEN 'Value' ELSE 'Overall' END"
_BUCKET = "CASE WHEN label IN ('Overall Satisfaction', 'Overall Dissatisfaction', 'Good Value') THEN 'Universal Neutral' WHEN label = 'Loud' THEN 'Category Driver' ELSE 'Product Specific' END"


@query("x14_themes", _TAGS + f"SELECT label, {_THEME} AS theme, {_BUCKET} AS bucket, count(*) AS n FROM tl GROUP BY ALL")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    long = audit.label_counts(counted_tags(spark, sf)).groupBy("label").agg(F.sum("n").alias("n"))
    return long.withColumns({"theme": taxonomy.label_theme("label"), "bucket": taxonomy.label_bucket("label", ["Loud"])})


@query("a24_taxonomy_summary", _TAGS + f"SELECT side, theme, count(DISTINCT label) AS labels, count(*) FILTER (bucket = 'Category Driver') AS category, count(*) FILTER (bucket = 'Product Specific') AS product, count(*) FILTER (bucket = 'Universal Neutral') AS universal FROM (SELECT DISTINCT side, label, {_THEME} AS theme, {_BUCKET} AS bucket FROM tl) GROUP BY 1, 2")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.label_counts(counted_tags(spark, sf)).select("side", "label")
    return audit.taxonomy_summary(rows.withColumns({"theme": taxonomy.label_theme("label"), "bucket": taxonomy.label_bucket("label", ["Loud"])}))


#: Labels of words that the documents use, for support.
WORDS = [("of the", "detractor", ["in the"]), ("that was", "delighter", []), ("never heard here", "delighter", []), ("and for", "detractor", [])]
_STEM = "CASE " + " ".join(f"WHEN length(w) > {len(e) + 2} AND ends_with(w, '{e}') THEN left(w, length(w) - {len(e)})" for e in ENDINGS) + " ELSE w END"


def _support_sql() -> str:
    parts = []
    for i, (label, side, aliases) in enumerate(WORDS):
        own = sorted({stem(w) for w in label.split() if len(w) > 1})
        said = " OR ".join(f"contains(p, '{x}')" for x in (label, *aliases))
        enough = f"len(list_intersect(s, {own})) >= {0.8 * len(own)}"
        parts.append(f"SELECT {i} AS position, '{label}' AS label, '{side}' AS side, {float(min(max(len(own), 1), 5))} AS specificity, count(*) FILTER ({said} OR {enough}) AS hits, count(*) FILTER ({said}) AS phrase_hits, count(*) AS total FROM w")
    return f"""{_T.rstrip()}, p AS (SELECT review_id, array_to_string(regexp_extract_all(replace(lower(review_text), '’', ''''), '[a-z0-9'']+'), ' ') AS p FROM texts WHERE regexp_replace(coalesce(review_text, ''), '\\s', '', 'g') <> ''),
w AS (SELECT p, list_transform(string_split(p, ' '), lambda w: {_STEM}) AS s FROM p), h AS ({' UNION ALL '.join(parts)}),
sup AS (SELECT position, label, side, hits AS review_hits, round(hits / greatest(total, 1), 4) AS support_ratio, round(hits + hits / greatest(total, 1) + 0.12 * specificity + least(0.35, 0.05 * phrase_hits), 4) AS score, specificity FROM h)"""


@query("a26_label_support", _support_sql() + " SELECT * FROM sup")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.label_support(review_texts(spark, sf), WORDS, examples=0).drop("examples")


@query("a29_prioritized_labels", _support_sql() + ", c AS (SELECT label, side, review_hits, score, CASE WHEN label = 'that was' THEN 'Category Driver' ELSE 'Product Specific' END AS bucket, specificity FROM sup WHERE review_hits >= 1) SELECT label, side, bucket, review_hits, score, row_number() OVER (PARTITION BY side ORDER BY bucket, review_hits DESC, score DESC, specificity DESC, label) AS rank FROM c")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    candidates = spark.createDataFrame([(a, s, al) for a, s, al in WORDS], "label string, side string, aliases array<string>")
    return taxonomy.prioritize_labels(candidates, taxonomy.label_support(review_texts(spark, sf), WORDS, examples=0), ["that was"]).select("label", "side", "bucket", "review_hits", "score", "rank")


KEYWORDS = {"first": ["of the", "zzqq"], "second": ["thing", "and the", "qqzz"], "third": ["wwvv"]}


def _category_sql() -> str:
    hit = lambda k: f"CASE WHEN max(CASE WHEN contains(t, '{k}') THEN 1 ELSE 0 END) = 1 THEN {1.0 if ' ' in k else 0.6} ELSE 0 END"
    scores = ", ".join(f"round({' + '.join(hit(k) for k in ks)}, 6) AS {c}" for c, ks in KEYWORDS.items())
    return f"""{_T.rstrip()}, t AS (SELECT retailer AS product_id, lower(trim(regexp_replace(coalesce(review_text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS t FROM texts), s AS (SELECT product_id, {scores} FROM t GROUP BY 1),
r AS (SELECT *, greatest(first, second, third) AS best, list_sort([first, second, third], 'DESC')[2] AS next FROM s)
SELECT product_id, CASE WHEN best = 0 THEN 'general' WHEN first = best THEN 'first' WHEN second = best THEN 'second' ELSE 'third' END AS category, CASE WHEN best = 0 THEN 0 ELSE round(least(greatest(best / greatest(best + next + 0.5, 1), 0.15), 0.98), 2) END AS confidence FROM r"""


@query("a28_categories", _category_sql())
def a28(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.infer_category(review_texts(spark, sf).withColumnRenamed("retailer", "product_id"), keywords=KEYWORDS).drop("signals")


@query("a30_watch_alerts", _WATCH + """, wk AS (SELECT Retailer, Region, date_trunc('week', date) AS week, count(*) AS n, sum(rating) AS stars FROM w WHERE date IS NOT NULL AND rating IS NOT NULL GROUP BY 1, 2, 3), few AS (SELECT DISTINCT week FROM wk ORDER BY 1 DESC LIMIT 40),
x AS (SELECT Retailer, Region, max(mw)::TIMESTAMP AS week, coalesce(sum(n) FILTER (week = mw), 0)::BIGINT AS reviews, coalesce(sum(n) FILTER (week < mw), 0)::BIGINT AS baseline_reviews, sum(stars) FILTER (week = mw) AS s, sum(stars) FILTER (week < mw) AS b FROM wk JOIN few USING (week), (SELECT max(week) AS mw FROM few) GROUP BY 1, 2)
SELECT Retailer, Region, week, reviews, baseline_reviews, round(s / reviews, 6) AS avg_rating, round(b / baseline_reviews, 6) AS baseline_avg, round(s / reviews - b / baseline_reviews, 6) AS change FROM x WHERE reviews >= 1 AND baseline_reviews >= 1 AND round(s / reviews - b / baseline_reviews, 6) <= -0.1""")
def a30d(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_alerts(_watched(spark, sf), 0.1, 1, 39)


@query("a30_watch_symptoms", _R.rstrip() + f""", e AS (SELECT retailer AS Retailer, {REGION} AS Region, rating, unnest(list_distinct(list_filter([{_LAB('det1')}, {_LAB('det2')}], lambda x: x IS NOT NULL))) AS label FROM reviews),
g AS (SELECT Retailer, Region, label, count(*) AS mentions, round(avg(rating), 6) AS avg_rating FROM e GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY Retailer, Region ORDER BY mentions DESC, label) AS rank FROM g) SELECT * FROM r WHERE rank <= 2""")
def a30e(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_symptoms(reviews(spark, sf), "retailer", "content_locale", DET_COLS, 2)


@query("x12_missed_sides", _TAGS + """, k AS (SELECT key, coalesce(t.rating, 3) AS s, len(dets) = 0 AS d, len(dels) = 0 AS l, lower(review_text) AS x FROM tags t JOIN reviews r ON r.review_id = t.key)
SELECT key, (d AND l) OR (d AND (s <= 3 OR regexp_matches(x, '\\b(issue|problem|fail)\\b'))) AS missed_dets, (d AND l) OR (l AND (s >= 3 OR regexp_matches(x, '\\b(best|easy|great)\\b'))) AS missed_dels FROM k""")
def x12b(spark: SparkSession, sf: str) -> DataFrame:
    rows = tags(spark, sf)
    return audit.flag_missed_side(rows.drop("rating", "review_text"), rows).select("key", "missed_dets", "missed_dels")


def _times(words: list[str], cap: int) -> str:
    pattern = L.any_phrase(words).replace("'", "''")
    return f"least(len(regexp_extract_all(lower(title_and_text), '{pattern}')), {cap})"


@query("t4_priority", _R + f"SELECT review_id, round(CASE WHEN coalesce(rating, 3) <= 2 THEN 4.0 WHEN coalesce(rating, 3) >= 4.5 THEN 2.5 WHEN coalesce(rating, 3) BETWEEN 2.5 AND 3.5 THEN 1.2 ELSE 0 END + least(review_length_words, 500) / 120 + {_times(rank.NEGATIVE, 4)} * 0.9 + {_times(rank.POSITIVE, 4)} * 0.45 + {_times(rank.MIXED, 2)} * 0.9 + least(length(title_and_text), 1200) / 1500, 6) AS priority FROM reviews")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return rank.prioritize_for_tagging(reviews(spark, sf)).select("review_id", "priority")


@query("t5_sample")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return rank.sample_reviews(review_texts(spark, sf), 60)


for _mode, _order in (("newest", "submission_time DESC NULLS LAST"), ("lowest", "rating ASC NULLS LAST"), ("longest", "review_length_chars DESC NULLS LAST")):

    @query(f"t1_{_mode}", _R + f"SELECT review_id FROM reviews ORDER BY {_order}, review_id LIMIT 200")
    def t1(spark: SparkSession, sf: str, mode: str = _mode) -> DataFrame:
        return rank.sort_reviews(reviews(spark, sf), mode).select("review_id").limit(200)


@query("t6_search")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf)
    return products.search_entities(products.base_model_directory(rows), products.product_directory(rows), "hot geer brand#12")


@query("t7_opportunities", f"SELECT label, impact FROM ({CATALOG_SQL['a16_impact_detractors']}) WHERE avg_star IS NOT NULL ORDER BY abs(impact) DESC, mentions DESC, label LIMIT 2")
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return rank.opportunity_top(symptoms.symptom_impact(reviews(spark, sf), DET_COLS), 2).select("label", "impact")


@query("f13_symptom_table", f"SELECT label, mentions, pct_tagged FROM ({CATALOG_SQL['a15_symptom_table']}) WHERE contains(lower(label), 'o') AND pct_tagged >= 1 ORDER BY mentions DESC, label LIMIT 2")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return audit.filter_symptom_table(symptoms.symptom_table(reviews(spark, sf), DET_COLS), "O", 1, 1.0, limit=2).select("label", "mentions", "pct_tagged")


@query("f10_total", _R + "SELECT count(*) AS total FROM reviews WHERE mapped_category IN ('PROMO')")
def f10b(spark: SparkSession, sf: str) -> DataFrame:
    return filters.workspace_total(reviews(spark, sf), mapped_category=["PROMO"])


@query("f11_analytics", _R + "SELECT review_id, rating, country, mapped_brand FROM reviews WHERE mapped_brand IN ('Brand#11', 'Brand#2') AND NOT incentivized_review ORDER BY submission_time DESC, review_id DESC LIMIT 300")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return filters.analytics_frame(reviews(spark, sf), 300, brands=["Brand#11", "Brand#2"], organic_only=True).select("review_id", "rating", "country", "mapped_brand")


@query("f12_lookup", _R + "SELECT review_id, rating FROM reviews WHERE mapped_brand = 'Brand#11' AND retailer = 'BUILDING'")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return filters.get_reviews(reviews(spark, sf), {"mapped_brand": "Brand#11", "retailer": "BUILDING"}).select("review_id", "rating")


@query("f4_inferred_kinds", _R + "SELECT review_id FROM reviews WHERE review_length_words BETWEEN 12 AND 30 AND submission_time::DATE BETWEEN '1998-01-01' AND '1999-12-31' AND retailer IN ('BUILDING') AND contains(lower(review_id), '11')")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    specs = {"review_length_words": {"min": 12, "max": 30}, "submission_time": {"start": "1998-01-01", "end": "1999-12-31"}, "retailer": {"values": ["BUILDING"]}, "review_id": {"text": "11"}}
    return filters.filter_extra(reviews(spark, sf), specs).select("review_id")


@query("i9_manifest", f"WITH e AS ({CATALOG_SQL['j1_enrich']}) SELECT count(*) AS row_count, count(*) FILTER (match_type <> 'unmatched') AS mapped_count, count(*) FILTER (match_type = 'unmatched') AS unmatched_count FROM e")
def i9(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf).drop("mapped_brand", "mapped_category", "mapped_subcategory", "base_model_number", "master_item")
    return products.import_manifest(products.enrich_with_catalog(rows, _sku_catalog(spark, sf))).select("row_count", "mapped_count", "unmatched_count")


@query("i6_combined_catalog", "SELECT count(*) AS rows, count(DISTINCT p_brand) AS brands FROM (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END AS sku, CASE WHEN p_partkey % 3 = 1 THEN (p_partkey % 500)::VARCHAR END AS mi, p_brand, p_type FROM part WHERE p_partkey % 3 < 2)")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    both = products.combine_catalogs(_sku_catalog(spark, sf), _sku_catalog(spark, sf))
    return both.agg(F.count("*").alias("rows"), F.countDistinct("brand").alias("brands"))


_CTX = "[{'n': '', 'v': title_and_text}, {'n': 'Title: ', 'v': title}, {'n': 'Country: ', 'v': coalesce(country, '')}, {'n': 'Retailer: ', 'v': retailer}, {'n': 'Brand: ', 'v': mapped_brand}]"


@query("n17_context", _R.rstrip() + f", c AS (SELECT review_id, list_filter({_CTX}, lambda x: length(x.v) >= 3) AS p FROM reviews) SELECT review_id, array_to_string(list_transform(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y.v)), lower(x.v)) = i), lambda x: x.n || x.v), chr(10)) AS context FROM c")
def n17(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf).select("review_id", "title_and_text", "title", "country", "retailer", F.col("mapped_brand").alias("brand"))
    return rows.select("review_id", review_context(rows).alias("context"))


@query("n21_normalized_tags", _R + f"SELECT review_id, list_sort(list_distinct(list_filter([{_LAB('det1')}, {_LAB('det2')}], lambda x: x IS NOT NULL))) AS t, 1 AS one FROM reviews")
def n21(spark: SparkSession, sf: str) -> DataFrame:
    rows = reviews(spark, sf).select("review_id", F.array_compact(F.array(*[F.col(f"`{c}`") for c in DET_COLS])).alias("raw"))
    return rows.select("review_id", F.array_sort(L.normalize_tags("raw")).alias("t"), F.lit(1).alias("one"))


@query("n22_universal", _TAGS + "SELECT key, CASE WHEN list_contains(dets, 'Overall Dissatisfaction') AND len(dets) > 1 THEN len(dets) - 1 ELSE len(dets) END::INT AS kept, (len(dets) + CASE WHEN list_contains(dets, 'Overall Dissatisfaction') THEN 0 ELSE 1 END)::INT AS ensured, (len(dets) - CASE WHEN list_contains(dets, 'Overall Dissatisfaction') THEN 1 ELSE 0 END)::INT AS stripped FROM tags")
def n22(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("dets")
    return tags(spark, sf).select("key", F.size(audit.strip_overall_fallback(d)).alias("kept"), F.size(audit.ensure_universal(d, "detractor")).alias("ensured"), F.size(audit.strip_universal(d)).alias("stripped"))


@query("u3_followup", _TAGS + "SELECT key, CASE WHEN key LIKE '%1' THEN dels ELSE dets END::VARCHAR[] AS merged, CASE WHEN key LIKE '%1' THEN len(dels) ELSE 0 END::INT AS added FROM (SELECT key, list_sort(dets) AS dets, list_sort(dels) AS dels FROM tags)")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    rows = tags(spark, sf).select("key", F.array_sort("dets").alias("dets"), F.array_sort("dels").alias("dels"))
    base = rows.withColumn("dets", F.when(F.col("key").like("%1"), F.array().cast("array<string>")).otherwise(F.col("dets")))
    out = merge.merge_followup_tags(base, rows.select("key", F.col("dels").alias("dets"), F.col("dets").alias("dels")))
    return out.select("key", F.col("dets").alias("merged"), F.size("added_dets").alias("added"))


@query("u4_passes", _TAGS + "SELECT key, list_sort(list_distinct(list_concat(dets, dels))) AS t FROM tags")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    rows = tags(spark, sf)
    one = lambda c: rows.select("key", F.col(c).alias("tags"), F.lit(None).cast("map<string,array<string>>").alias("evidence"))
    return merge.merge_passes(one("dets"), one("dels")).select("key", F.array_sort("tags").alias("t"))


@query("x19_reuse", "SELECT (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) >= 0 AS known_found, (SELECT count(DISTINCT trim(coalesce(text, ''), ' ')) FROM documents) AS texts")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    rows = review_texts(spark, sf).select("review_id", "review_text")
    known, open_ = audit.reuse_tags(rows, spark.createDataFrame([], "cache_key string, result string"), "c", "m")
    return open_.agg(F.count("*").alias("texts")).crossJoin(known.agg((F.count("*") >= 0).alias("known_found")))


_CACHED = "trim(coalesce(text, ''), ' ') IN (SELECT trim(coalesce(text, ''), ' ') FROM documents WHERE doc_id % 2 = 0)"


@query("x19_cached", f"SELECT doc_id::VARCHAR AS review_id, 'known' AS state, (SELECT min(d.doc_id) FROM documents d WHERE d.doc_id % 2 = 0 AND trim(coalesce(d.text, ''), ' ') = trim(coalesce(documents.text, ''), ' '))::VARCHAR AS result FROM documents WHERE {_CACHED} UNION ALL SELECT min(doc_id::VARCHAR), 'open', NULL FROM documents WHERE NOT {_CACHED} GROUP BY trim(coalesce(text, ''), ' ')")
def x19b(spark: SparkSession, sf: str) -> DataFrame:
    """A cache that has the tags of every second document: all documents of those texts reuse them, of the others one a text is open. Entries of another catalog or model do not count."""
    rows = review_texts(spark, sf).select("review_id", "review_text")
    entry = lambda df, catalog, result: df.groupBy(audit.cache_key("review_text", catalog, "m").alias("cache_key")).agg(result.alias("result"))
    even = rows.where(F.col("review_id").cast("long") % 2 == 0)
    cache = entry(even, "c", F.min(F.col("review_id").cast("long")).cast("string")).unionByName(entry(rows, "other", F.lit("wrong")))
    known, open_ = audit.reuse_tags(rows, cache, "c", "m")
    return known.select("review_id", F.lit("known").alias("state"), "result").unionByName(open_.select("review_id", F.lit("open").alias("state"), F.lit(None).cast("string").alias("result")))


@query("x18_batches_numbered", "WITH p AS (SELECT greatest(ceil(length(coalesce(text, '')) / 3.5), 1) AS tokens, length(text) > 600 AS long FROM documents) SELECT CASE WHEN long THEN 'long' ELSE 'short' END AS route, least(greatest(floor(4000 / tokens), 2), 10)::BIGINT AS batch_size, count(*) AS reviews, true AS full FROM p GROUP BY ALL")
def x18b(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.number_batches(review_texts(spark, sf))
    by = rows.groupBy("shard", "route", "batch_size", "batch").agg(F.count("*").alias("n"))
    return by.groupBy("route", "batch_size").agg(F.sum("n").alias("reviews"), F.bool_and(F.col("n") <= F.col("batch_size")).alias("full"))


#: For each of SAID what an external tagger might have written: (label, quoted span) by side.
WRITTEN = [
    ([("LOUD", "motor is loud")], []), ([("Loud", "noise")], [("quiet", "no issues with noise")]), ([], [("Quiet!", "It is quiet")]), ([("too loud", "not as quiet as hoped")], [("Quiet", "quiet")]),
    ([], [("Easy To Clean", "easy to clean")]), ([("hard to clean", "hard to clean and dirty")], []), ([("Loud", "box is blue")], []),
]


def _payload(at: int) -> str:
    import json

    side = lambda tags: [{"label": a, "evidence": [b]} for a, b in tags]
    return json.dumps({"detractors": side(WRITTEN[at][0]), "delighters": side(WRITTEN[at][1]), "safety": "positive" if at == 2 else "??"})


@query("x10_postprocessed", _SAID + f" SELECT review_id, {_labels_sql(1)} AS dets, {_labels_sql(2)} AS dels, CASE i WHEN 2 THEN 'Positive' ELSE 'Not Mentioned' END AS safety FROM k")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    rows = _said(spark, sf)
    at = F.array_position(F.array(*[F.lit(s) for s, _, _ in SAID]), F.col("review_text")) - 1
    raw = rows.select("review_id", _pick([_payload(i) for i in range(len(SAID))], at).alias("payload"))
    return matching.postprocess_tags(raw, rows, CATALOG).select("review_id", "dets", "dels", "safety")


@query("x8_valid_spans", _SAID + " SELECT CASE i WHEN 0 THEN 'motor is loud' WHEN 2 THEN 'quiet' WHEN 3 THEN '' ELSE '' END AS span, count(*) AS n FROM k GROUP BY 1")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    rows = _said(spark, sf)
    said = F.when(F.col("review_text").contains("motor"), "Motor  is loud").when(F.col("review_text").contains("quiet"), "quiet").otherwise("nowhere in it")
    checked = matching.validate_evidence(rows.select("review_id", F.lit("Quiet").alias("label"), F.array(said).alias("evidence")), rows)
    return checked.select(F.coalesce(F.try_element_at("spans", F.lit(1)), F.lit("")).alias("span")).groupBy("span").agg(F.count("*").alias("n"))


#: Frequent words of the documents and the word of a denial that each is read as, so that whole texts hold every kind of denial.
READ_AS = {"of": "not", "and": "very", "to": "no", "a": "problem", "in": "with", "is": "missing", "that": "never", "it": "noticed", "for": "without", "was": "any", "on": "only", "as": "at", "this": "free", "be": "but", "by": "supposed", "are": "to", "at": "as", "from": "could", "with": "be", "an": "better"}
DENIED_WORDS = ["the", "th", "er"]
_OR = lambda words: "(" + "|".join(words) + ")"


def _denied_sql(p: str) -> str:
    """The rules of denial as patterns over the tokens of a text, joined with spaces."""
    upto = lambda n: f"( [^., ]+){{0,{n}}}"
    ways = [
        rf" {_OR(N.DENIALS)}( {_OR(N.DEGREES)})* {p} ", rf" without( {_OR(N.DEGREES)})* {_OR(N.ARTICLES)}( {_OR(N.DEGREES)})* {p} ", rf" ({'|'.join(N.LACKS)}|free of|{_OR(N.NEEDS)} more) {p} ", rf" no {_OR(N.TROUBLES)} {_OR(N.ABOUT)}{upto(5)} {p} ",
        rf" never {_OR(N.MET)}{upto(3)} {p} ", rf" zero{upto(3)} {p} ", rf" not as {p} as ", rf" {p} free ", rf" no {p}( [^. ]+){{0,4}} (at all|whatsoever|to speak of) ", rf" {_OR(N.WISHES)} (be|[^. ]+ been) {_OR(N.BETTER)}( [^. ]+){{0,9}} {p} ",
        rf" {_OR(N.CLAIMS)} to( be)? {p} (.* )?{_OR(N.TURNS)} ", rf" {_OR(N.ONLY)} {p} {_OR(N.TIMES)} ",
    ]
    return " OR ".join(f"regexp_matches(s, '{w}')" for w in (x.replace("'", "''") for x in ways))


def _tokens_sql() -> str:
    text = "lower(coalesce(text, ''))"
    for pattern, said in N._MARKS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{said.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


@query("x2_negated", f"""WITH t AS (SELECT doc_id, {_tokens_sql()} AS w FROM documents),
s AS (SELECT doc_id, ' ' || array_to_string(list_transform(w, lambda x: CASE x {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in READ_AS.items())} ELSE x END), ' ') || ' ' AS s FROM t)
SELECT doc_id, {', '.join(f"{_denied_sql(p)} AS {p}" for p in DENIED_WORDS)} FROM s""")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    read_as = F.create_map(*[F.lit(x) for pair in READ_AS.items() for x in pair])
    words = F.transform(N.token_array(F.col("text")), lambda w: F.coalesce(F.try_element_at(read_as, w), w))
    rows = table(spark, sf, "documents").select("doc_id", words.alias("words"))
    return rows.select("doc_id", *[N.negated(p, F.col("words")).alias(p) for p in DENIED_WORDS])


_TYPE = "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("a31_merged", f"""WITH RECURSIVE u AS (SELECT DISTINCT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'detractor' ELSE 'delighter' END AS side, {_TYPE} AS label FROM part), k AS (SELECT side, label, count(*) AS count FROM u GROUP BY 1, 2),
s AS (SELECT side, label, list_distinct(list_transform(list_filter(string_split(lower(label), ' '), lambda w: length(w) > 2), lambda w: {_STEM})) AS st FROM k),
p AS (SELECT a.side, a.label AS x, b.label AS y FROM s a JOIN s b ON a.side = b.side AND a.label <> b.label WHERE len(list_intersect(a.st, b.st)) / greatest(len(a.st), len(b.st)) >= 0.55),
r AS (SELECT side, label AS x, label AS y FROM k UNION SELECT r.side, r.x, p.y FROM r JOIN p ON p.side = r.side AND p.x = r.y),
b AS (SELECT r.side, r.x, k.label, row_number() OVER (PARTITION BY r.side, r.x ORDER BY k.count DESC, k.label) AS rn FROM r JOIN k ON k.side = r.side AND k.label = r.y)
SELECT k.side, k.label, k.count, nullif(b.label, k.label) AS merged_into FROM k JOIN b ON b.side = k.side AND b.x = k.label AND rn = 1""")
def a31b(spark: SparkSession, sf: str) -> DataFrame:
    """The types of parts as unlisted labels: those that share stems hang together in chains."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_size") % 2 == 0, "detractor").otherwise("delighter").alias("side"), F.col("p_type").alias("label"))
    return audit.merged_candidates(audit.candidate_labels(rows, parts=parts_of(spark, sf, "part"))).select("side", "label", "count", "merged_into")


@query("i5_vendor_catalog", """SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_size % 3 > 0 THEN p_type END AS master_item, CASE WHEN p_size % 3 > 0 THEN upper(p_type) END AS master_item_key, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'House' END AS brand, p_name AS description, CASE WHEN p_size % 3 > 0 THEN p_type ELSE p_partkey::VARCHAR END AS base_model_number,
concat_ws(' · ', p_name, CASE WHEN p_size % 5 = 0 THEN 'size ' || p_size END, nullif(trim(p_type), '')) AS item_long_description FROM part""")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a second vendor's catalog."""
    size = F.col("p_size")
    raw = table(spark, sf, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("Product ID"), F.when(size % 3 > 0, F.col("p_type")).otherwise(" ").alias("Model Code"), F.when(size % 2 == 0, F.col("p_brand")).otherwise("").alias("Brand"), F.col("p_name").alias("Product Name"), F.when(size % 5 == 0, F.concat(F.lit("size "), size.cast("string"))).alias("Color Variant"), F.col("p_type").alias("Notes"))
    return products.load_vendor_catalog(raw, "House").select("sku", "master_item", "master_item_key", "brand", "description", "base_model_number", "item_long_description")


@query("x15_catalog", _R.rstrip() + f", {_RAW} SELECT DISTINCT side, {_STANDARD} AS label FROM raw WHERE {_STANDARD} <> ''")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.canonical_catalog(_raw(spark, sf).withColumnRenamed("raw_label", "label")).select("side", "label")
