"""The registered queries over the review operators, each with SQL for the same result.

Doubles are rounded to six places on both sides, so that the order of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import action, filters, merge, metrics, products, rank, social, symptoms
from .reviews import DEL_COLS, DET_COLS, MENTIONS_SQL, REVIEWS_SQL, TEXTS_SQL, mentions, review_texts, reviews, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_R, _T, _M = f"WITH {REVIEWS_SQL} ", f"WITH {TEXTS_SQL} ", f"WITH {MENTIONS_SQL} "


def six(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: six(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return action.prepare_action_frame(reviews(spark, sf))


@query("a1_metrics", _R + """
SELECT count(*) AS review_count, round(avg(rating), 6) AS avg_rating, round(avg(rating) FILTER (NOT incentivized_review), 6) AS avg_rating_non_incentivized, round(count(*) FILTER (rating < 3) / count(*), 6) AS pct_low_star, round(count(*) FILTER (rating = 1) / count(*), 6) AS pct_one_star, round(count(*) FILTER (rating = 2) / count(*), 6) AS pct_two_star,
round(count(*) FILTER (rating = 5) / count(*), 6) AS pct_five_star, round(count(*) FILTER (incentivized_review) / count(*), 6) AS pct_incentivized, round(count(*) FILTER (has_photos) / count(*), 6) AS pct_with_photos, round(count(*) FILTER (is_syndicated) / count(*), 6) AS pct_syndicated, round(avg(is_recommended::INT), 6) AS recommend_rate,
round(quantile_cont(review_length_words, 0.5), 6) AS median_review_words, count(*) FILTER (NOT incentivized_review) AS non_incentivized_count, count(*) FILTER (rating < 3) AS low_star_count, count(rating) AS rated_count, count(rating) FILTER (NOT incentivized_review) AS organic_rated_count, count(*) FILTER (incentivized_review) AS incentivized_count FROM reviews""")  # fmt: skip
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.compute_metrics(reviews(spark, sf))


@query("a2_rating_distribution", _R + """
SELECT s::INT AS star, count(r.rating) AS review_count, round(count(r.rating) / (SELECT count(*) FROM reviews), 6) AS share FROM range(1, 6) t(s) LEFT JOIN reviews r ON least(greatest(round_even(r.rating, 0), 1), 5) = s GROUP BY s""")  # fmt: skip
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rating_distribution(reviews(spark, sf))


@query("a3_monthly_trend", _R + "SELECT date_trunc('month', submission_time)::TIMESTAMP AS month_start, count(review_id) AS review_count, round(avg(rating), 6) AS avg_rating FROM reviews GROUP BY 1")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.monthly_trend(reviews(spark, sf))


@query("a4_cohorts", _R + """
SELECT i AS incentivized, s::INT AS star, count(r.review_id) AS review_count, round(count(r.review_id) / (SELECT count(rating) FROM reviews x WHERE x.incentivized_review = i), 6) AS share
FROM range(1, 6) t(s) CROSS JOIN (VALUES (true), (false)) v(i) LEFT JOIN reviews r ON floor(r.rating) = s AND r.incentivized_review = i GROUP BY 1, 2""")  # fmt: skip
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cohort_by_incentivized(reviews(spark, sf))


_TOP = "SELECT {c} AS value, count(*) AS review_count, avg(rating) AS a FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"


@query("a5_locale_breakdown", _R + f", k AS ({_TOP.format(c='content_locale', n=12)}) SELECT value, review_count, round(a, 6) AS avg_rating, round(review_count / sum(review_count) OVER (), 6) AS share FROM k")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.locale_breakdown(reviews(spark, sf))


@query("a6_top_locations", _R + f", k AS ({_TOP.format(c='user_location', n=10)}) SELECT value, review_count, round(a, 6) AS avg_rating FROM k")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_locations(reviews(spark, sf))


@query("a7_length_cohorts", _R + """, e AS (SELECT quantile_cont(review_length_words, [0.25, 0.5, 0.75]) AS q FROM reviews),
c AS (SELECT CASE WHEN review_length_words <= q[1] THEN 'Q1' WHEN review_length_words <= q[2] THEN 'Q2' WHEN review_length_words <= q[3] THEN 'Q3' ELSE 'Q4' END AS cohort, rating, review_length_words AS w FROM reviews, e)
SELECT cohort, count(*) AS review_count, round(avg(rating), 6) AS avg_rating, round(quantile_cont(w, 0.5), 6) AS median_words FROM c GROUP BY 1""")  # fmt: skip
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.review_length_cohort(reviews(spark, sf))


@query("a8_star_bands", _R + """
SELECT date_trunc('month', submission_time)::TIMESTAMP AS month_start, count(*) AS review_count, count(*) FILTER (rating BETWEEN 1 AND 2) AS low_count, count(*) FILTER (rating BETWEEN 4 AND 5) AS high_count,
round(count(*) FILTER (rating BETWEEN 1 AND 2) / count(*), 6) AS low_share, round(count(*) FILTER (rating BETWEEN 4 AND 5) / count(*), 6) AS high_share FROM reviews WHERE rating IS NOT NULL GROUP BY 1""")  # fmt: skip
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.star_band_trend(reviews(spark, sf))


_DIR = "count(*) AS row_count, count(DISTINCT review_id) AS review_count, count(DISTINCT product_id) AS product_count, round(avg(rating), 3) AS avg_rating, min(submission_time)::DATE::VARCHAR AS first_date, max(submission_time)::DATE::VARCHAR AS last_date"
_KEYS = "coalesce(mapped_brand, 'UNMAPPED') AS mapped_brand, coalesce(mapped_category, 'UNMAPPED') AS mapped_category, coalesce(mapped_subcategory, 'UNMAPPED') AS mapped_subcategory, coalesce(master_item, 'UNMAPPED') AS master_item"
_PDIR = f"SELECT product_id, original_product_name, base_model_number, {_KEYS}, {_DIR} FROM reviews GROUP BY ALL"


@query("a9_base_model_directory", _R + f"SELECT base_model_number, {_KEYS}, {_DIR} FROM reviews GROUP BY ALL")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return _dates(products.base_model_directory(reviews(spark, sf)))


@query("a10_product_directory", _R + _PDIR)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return _dates(products.product_directory(reviews(spark, sf)))


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


_PICK = {"mapped_brand": ["Brand#11", "Brand#2"], "mapped_category": ["PROMO", "LARGE"]}
_WHERE = {"mapped_brand": "mapped_brand IN ('Brand#11', 'Brand#2')", "mapped_category": "mapped_category IN ('PROMO', 'LARGE')"}


def _facet(field: str) -> str:
    rest = " AND ".join(v for k, v in _WHERE.items() if k != field)
    return f"SELECT * FROM (SELECT '{field}' AS field, {field} AS value, sum(row_count)::BIGINT AS review_count FROM d WHERE {rest} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5000)"


@query("a11_facets", _R + f", d AS ({_PDIR}) " + " UNION ALL ".join(map(_facet, products.FACETS)))
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return products.facet_options(products.product_directory(reviews(spark, sf)), **_PICK)


@query("a12_selection_count", _R + f"SELECT count(*) AS review_count FROM reviews WHERE {' AND '.join(_WHERE.values())}")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return products.selection_count(products.product_directory(reviews(spark, sf)), **_PICK)


def _trend(cols: str, freq: str, where: str = "true") -> str:
    return f"SELECT {cols}, date_trunc('{freq}', submission_time)::TIMESTAMP AS period_start, count(review_id) AS review_count, avg(rating) AS avg_rating, avg(low_star::INT) AS low_star_share, avg(organic_flag::INT) AS organic_share FROM prepared WHERE {where} GROUP BY ALL"


def _delta(trend: str, cols: str, recent: int, baseline: int) -> str:
    part = lambda n, s, k: f"avg({s}) FILTER (age {k} {recent}) AS {n}"
    both = [part(f"{pre}_{n}", s, k) for pre, k in (("latest", "<="), ("baseline", ">")) for n, s in (("reviews", "review_count"), ("avg_rating", "avg_rating"), ("low_star_share", "low_star_share"), ("organic_share", "organic_share"))]
    return f"""SELECT *, latest_avg_rating - baseline_avg_rating AS rating_delta, latest_low_star_share - baseline_low_star_share AS low_star_delta, CASE WHEN baseline_reviews > 0 THEN latest_reviews / baseline_reviews - 1 END AS volume_delta_pct
FROM (SELECT {cols}, max(period_start) FILTER (age <= {recent}) AS latest_period_start, {', '.join(both)} FROM {trend} JOIN (SELECT period_start, row_number() OVER (ORDER BY period_start DESC) AS age FROM (SELECT DISTINCT period_start FROM {trend})) USING (period_start) WHERE age <= {recent + baseline} GROUP BY {cols}) WHERE latest_period_start IS NOT NULL"""


_DELTAS = "round(rating_delta, 6) AS rating_delta, round(low_star_delta, 6) AS low_star_delta, round(volume_delta_pct, 6) AS volume_delta_pct"
_WINDOWS = "latest_period_start, " + ", ".join(f"round({p}_{n}, 6) AS {p}_{n}" for p in ("latest", "baseline") for n in ("reviews", "avg_rating", "low_star_share", "organic_share"))


def _summary(cols: list[str], least: int, name: str = "s", where: str = "true") -> str:
    """CTEs named name*: the dimension summary, unrounded, with segment and direction."""
    by = ", ".join(cols)
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM m.{c}" for c in cols)
    return f"""{name}t AS ({_trend(by, 'month', where)}), {name}d AS ({_delta(name + 't', by, 2, 4)}),
{name}b AS (SELECT {by}, count(review_id) AS review_count, avg(rating) AS avg_rating, avg(low_star::INT) AS low_star_share, avg(organic_flag::INT) AS organic_share, count(DISTINCT country) AS country_count, count(DISTINCT product_id) AS product_count FROM prepared WHERE {where} GROUP BY ALL HAVING count(review_id) >= {least}),
{name}j AS (SELECT b.*, m.* EXCLUDE ({by}) FROM {name}b b LEFT JOIN {name}d m ON {on}),
{name}o AS (SELECT avg(rating) AS oa, avg(low_star::INT) AS ol, (SELECT greatest(quantile_cont(review_count, 0.65), 50) FROM {name}b) AS cut FROM prepared WHERE {where}),
{name} AS (SELECT j.*, CASE WHEN review_count >= cut AND (coalesce(avg_rating <= oa - 0.15, false) OR coalesce(low_star_share >= ol + 0.05, false) OR coalesce(rating_delta <= -0.18, false)) THEN 'Fix now'
WHEN review_count >= cut AND coalesce(avg_rating >= oa + 0.12, false) AND (rating_delta IS NULL OR rating_delta >= 0.08) THEN 'Scale' WHEN review_count >= cut AND coalesce(rating_delta <= -0.10, false) THEN 'Protect'
WHEN coalesce(abs(rating_delta) >= 0.10, false) OR coalesce(abs(volume_delta_pct) >= 0.25, false) THEN 'Watch' ELSE 'Stable' END AS segment,
CASE WHEN rating_delta >= 0.08 THEN 'Improving' WHEN rating_delta <= -0.08 THEN 'Softening' ELSE 'Stable' END AS trend_direction FROM {name}j j, {name}o)"""


_SUM_COLS = f"review_count, round(avg_rating, 6) AS avg_rating, round(low_star_share, 6) AS low_star_share, round(organic_share, 6) AS organic_share, country_count, product_count, {_WINDOWS}, {_DELTAS}, segment, trend_direction"
_BC = ["mapped_brand", "mapped_category"]


@query("a13_dimension_summary", _R + f", {_summary(_BC, 50)} SELECT mapped_brand, mapped_category, {_SUM_COLS} FROM s")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return action.summarize_dimension(action.held(_prepared(spark, sf), *_BC), _BC)


_MODE = "(SELECT mapped_brand, base_model_number, {c} AS v, row_number() OVER (PARTITION BY mapped_brand, base_model_number ORDER BY count(*) DESC, {c}) AS rn FROM prepared WHERE {c} IS NOT NULL GROUP BY 1, 2, 3)"
_BM = ["mapped_brand", "base_model_number"]


@query("a14_base_models", _R + f", {_summary(_BM, 25)} SELECT s.mapped_brand, s.base_model_number, {_SUM_COLS}, c.v AS mapped_category, NULL::VARCHAR AS mapped_subcategory, n.v AS exemplar_product_name FROM s LEFT JOIN {_MODE.format(c='mapped_category')} c ON c.mapped_brand = s.mapped_brand AND c.base_model_number = s.base_model_number AND c.rn = 1 LEFT JOIN {_MODE.format(c='original_product_name')} n ON n.mapped_brand = s.mapped_brand AND n.base_model_number = s.base_model_number AND n.rn = 1")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return action.summarize_base_models(_prepared(spark, sf))


@query("w2_trend_series", _R + f", t AS ({_trend('mapped_brand, country', 'week')}) SELECT mapped_brand, country, period_start, review_count, round(avg_rating, 6) AS avg_rating, round(low_star_share, 6) AS low_star_share, round(organic_share, 6) AS organic_share FROM t")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return action.trend_series(_prepared(spark, sf), ["mapped_brand", "country"], "W")


@query("w3_windowed_delta", _R + f", t AS ({_trend('country', 'month')}), d AS ({_delta('t', 'country', 2, 4)}) SELECT country, {_WINDOWS}, {_DELTAS} FROM d")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return action.windowed_delta(action.trend_series(_prepared(spark, sf), ["country"], "M"), ["country"])


@query("w5_trend_movers", _R + f", t AS ({_trend('mapped_brand', 'week')}), d AS ({_delta('t', 'mapped_brand', 1, 4)}) SELECT coalesce(mapped_brand, 'All reviews') AS entity_label, round(latest_avg_rating, 6) AS latest_value, round(baseline_avg_rating, 6) AS baseline_value, round(rating_delta, 6) AS delta, round(latest_reviews, 6) AS latest_reviews, latest_period_start FROM d")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return action.trend_movers(_prepared(spark, sf), "mapped_brand")


def _feed() -> str:
    parts = [_summary(["mapped_brand", col], 50, f"s{i}") for i, (_, col) in enumerate(action.SPECS)]
    rows = " UNION ALL ".join(f"SELECT '{kind}' AS entity_kind, coalesce({col}, 'Unknown') AS entity_label, coalesce(mapped_brand, 'Unknown') AS brand, segment, review_count, avg_rating, rating_delta, low_star_share, volume_delta_pct FROM s{i}" for i, (kind, col) in enumerate(action.SPECS))
    stars, change = "coalesce(printf('%.2f stars', round(avg_rating::DECIMAL(18, 6), 2)), 'no rating')", "coalesce(printf('%+.2f', round(rating_delta::DECIMAL(18, 6), 2)), 'unknown')"
    return _R + f""", {', '.join(parts)}, u AS ({rows}) SELECT entity_kind, entity_label, brand, segment, review_count, round(avg_rating, 6) AS avg_rating, round(rating_delta, 6) AS rating_delta, round(low_star_share, 6) AS low_star_share, round(volume_delta_pct, 6) AS volume_delta_pct,
CASE WHEN segment = 'Fix now' AND (review_count >= 200 OR low_star_share >= 0.30) THEN 'Critical' WHEN segment IN ('Fix now', 'Protect') THEN 'High' WHEN segment IN ('Scale', 'Watch') THEN 'Medium' ELSE 'Low' END AS priority,
CASE WHEN segment = 'Fix now' THEN {stars} || ' on average, ' || printf('%.1f%%', round((low_star_share * 100)::DECIMAL(18, 6), 1)) || ' of ' || review_count || ' reviews low' WHEN segment = 'Protect' THEN 'rating change of ' || {change} || ' against the baseline' WHEN segment = 'Scale' THEN {stars} || ' on average, rating change ' || {change}
WHEN segment = 'Watch' AND abs(rating_delta) >= 0.08 THEN 'rating change of ' || {change} || ' to follow' WHEN segment = 'Watch' AND volume_delta_pct IS NOT NULL THEN 'number of reviews changed by ' || printf('%+.0f%%', round((volume_delta_pct * 100)::DECIMAL(18, 6), 0)) WHEN segment = 'Watch' THEN 'small change' ELSE 'no change to speak of' END AS reason,
CASE segment WHEN 'Fix now' THEN 'read the low reviews of ' || entity_label || ' and name the cause' WHEN 'Protect' THEN 'find what changed for ' || entity_label WHEN 'Scale' THEN 'learn from ' || entity_label || ' for others' WHEN 'Watch' THEN 'look at ' || entity_label || ' again next period' ELSE 'nothing to do for ' || entity_label END AS recommended_action FROM u"""


@query("w7_alert_feed", _feed())
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return action.alert_feed(_prepared(spark, sf))


@query("w1_cumulative_trend", _R + """, r AS (SELECT date_trunc('day', submission_time)::TIMESTAMP AS day, upper(right(content_locale, 2)) AS c, rating FROM reviews WHERE rating IS NOT NULL),
g AS (SELECT day, CASE c WHEN 'CA' THEN 'Canada' WHEN 'FR' THEN 'France' WHEN 'US' THEN 'USA' WHEN 'UK' THEN 'UK' WHEN 'GB' THEN 'UK' WHEN 'AU' THEN 'Australia' WHEN 'DE' THEN 'Germany' WHEN 'ES' THEN 'Spain' WHEN 'IT' THEN 'Italy' WHEN 'JP' THEN 'Japan' WHEN 'MX' THEN 'Mexico' WHEN 'BR' THEN 'Brazil' WHEN 'NL' THEN 'Netherlands' ELSE c END AS region, rating FROM r),
top AS (SELECT region FROM g GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2), s AS (SELECT day, 'Overall' AS series, rating FROM g UNION ALL SELECT day, region, rating FROM g WHERE region IN (FROM top)),
b AS (SELECT day, series, count(*) AS n, sum(rating) AS stars FROM s GROUP BY ALL), days AS (SELECT unnest(generate_series((SELECT min(day) FROM g), (SELECT max(day) FROM g), INTERVAL 1 DAY)) AS day),
f AS (SELECT days.day, x.series, coalesce(n, 0) AS volume, sum(stars) OVER w / sum(n) OVER w AS c FROM days CROSS JOIN (SELECT DISTINCT series FROM b) x LEFT JOIN b ON b.day = days.day AND b.series = x.series WINDOW w AS (PARTITION BY x.series ORDER BY days.day))
SELECT day, series, volume, round(avg(c) OVER (PARTITION BY series ORDER BY day ROWS 6 PRECEDING), 6) AS cum_avg FROM f""")  # fmt: skip
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative_region_trend(reviews(spark, sf))


for _mode, _days, _label in (("day", "1", "strftime(b, '%Y-%m-%d')"), ("week", "7", "'Week of ' || strftime(b, '%Y-%m-%d')"), ("month", "day(last_day(b))", "strftime(b, '%Y-%m')")):

    @query(f"w4_volume_{_mode}", _R + f"SELECT b AS bucket_start, b + to_microseconds(({_days} * 43200000000)::BIGINT) AS x, n AS volume, (({_days} - 0.15) * 86400000)::BIGINT AS width_ms, {_label} AS label FROM (SELECT date_trunc('{_mode}', submission_time)::TIMESTAMP AS b, count(*) AS n FROM reviews GROUP BY 1)")
    def w4(spark: SparkSession, sf: str, mode: str = _mode) -> DataFrame:
        trend = reviews(spark, sf).groupBy(F.date_trunc("day", "submission_time").alias("day")).agg(F.count(F.lit(1)).alias("volume"))
        return metrics.volume_series(trend, mode)


_CLEAN = {**{x: x.title() for x in ("loud", "hard to clean", "wrong size", "quiet", "easy to clean", "fast charging", "good value")}, "too loud": "Loud", "overall dissatisfaction": "Overall Dissatisfaction", "overall satisfaction": "Overall Satisfaction"}
_LAB = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CLEAN.items()) + " END"
_SEV = {"Loud": 1.18, "Hard To Clean": 1.18, "Wrong Size": 1.18}


def _long(side: str) -> str:
    return f"""a AS (SELECT row_number() OVER () AS review_id, rating AS star, list_distinct(list_filter([{_LAB(side + '1')}, {_LAB(side + '2')}], lambda x: x IS NOT NULL)) AS labels FROM reviews), t AS (SELECT * FROM a WHERE len(labels) > 0),
k AS (SELECT review_id, star, list_filter(labels, lambda x: x NOT IN ('Overall Dissatisfaction', 'Overall Satisfaction')) AS labels FROM t), l AS (SELECT review_id, star, len(labels) AS tags, unnest(labels) AS label FROM k)"""


def _impact_sql(side: str, by: str, label: str, rounded: bool) -> str:
    sign, gap, al = ("-1", "b - star", "b - avg_star") if side == "det" else ("1", "star - b", "avg_star - b")
    hit = "net_hit" if rounded else "raw_hit"
    return f"""f AS (SELECT count(*) AS total, avg(rating) AS b, (SELECT count(*) FROM t) AS tagged FROM reviews), m AS ({by.replace('GAP', f'coalesce(greatest({gap}, 0), 0)')}),
n AS (SELECT *, {sign} * raw / total AS raw_hit, round_even({sign} * raw / total, 3) AS net_hit, sqrt(mentions / (mentions + 3.0) * weighted / (weighted + 1.5)) * (0.45 + 0.55 * least(greatest(coalesce(greatest({al}, 0), 0) / 1.25, 0), 1)) AS conf FROM m),
o AS (SELECT *, round_even({hit} * conf, 3) AS forecast FROM n)
SELECT {label}, mentions, round_even(mentions / tagged * 100, 1) AS pct_tagged, round(avg_star, 6) AS avg_star, round_even(avg_tags, 2) AS avg_tags, round_even(least(greatest(conf, 0), 1) * 100, 1) AS confidence_pct, net_hit, forecast, round_even(forecast * severity, 3) AS impact, round(severity, 6) AS severity FROM o"""


_SEVERITY = {"det": "CASE label WHEN 'Loud' THEN 1.18 WHEN 'Hard To Clean' THEN 1.18 WHEN 'Wrong Size' THEN 1.18 ELSE 1.05 END", "del": "CASE label WHEN 'Quiet' THEN 1.08 WHEN 'Easy To Clean' THEN 1.20 WHEN 'Fast Charging' THEN 1.20 WHEN 'Good Value' THEN 1.08 ELSE 1.0 END"}
_BY_LABEL = "SELECT label, total, b, tagged, count(*) AS mentions, avg(star) AS avg_star, avg(tags) AS avg_tags, sum(1 / tags) AS weighted, sum(1 / tags * GAP) AS raw, any_value({sev}) AS severity FROM l, f GROUP BY ALL"


@query("a15_symptom_table", _R + f", {_long('det')} SELECT label, count(*) AS mentions, round(avg(star), 6) AS avg_star, round(avg(tags), 6) AS avg_tags, round(sum(1 / tags), 6) AS weighted_mentions, round_even(count(*) / (SELECT count(*) FROM t) * 100, 1) AS pct_tagged FROM l GROUP BY 1")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return symptoms.symptom_table(reviews(spark, sf), DET_COLS)


for _side, _kind, _cols in (("det", "detractors", DET_COLS), ("del", "delighters", DEL_COLS)):

    @query(f"a16_impact_{_kind}", _R + f", {_long(_side)}, {_impact_sql(_side, _BY_LABEL.format(sev=_SEVERITY[_side]), 'label', True)}")
    def a16(spark: SparkSession, sf: str, kind: str = _kind, cols: list[str] = _cols) -> DataFrame:
        return symptoms.symptom_impact(reviews(spark, sf), cols, kind)


_THEMES = {"Loud": "Noise", "Hard To Clean": "Care"}
_BY_THEME = f"""SELECT theme, total, b, tagged, count(*) AS mentions, avg(star) AS avg_star, avg(tags) AS avg_tags, sum(weight) AS weighted, sum(weight * GAP) AS raw, avg(sev) AS severity FROM
(SELECT review_id, theme, max(star) AS star, max(tags) AS tags, sum(1 / tags) AS weight, avg(sev) AS sev FROM (SELECT *, CASE label WHEN 'Loud' THEN 'Noise' WHEN 'Hard To Clean' THEN 'Care' ELSE 'Product Specific' END AS theme, {_SEVERITY['det']} AS sev FROM l) GROUP BY 1, 2), f GROUP BY ALL"""


@query("a17_theme_impact", _R + f", {_long('det')}, {_impact_sql('det', _BY_THEME, 'theme', False)}")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    themes = table(spark, sf, "region").limit(0).select(F.lit("").alias("label"), F.lit("").alias("theme"))
    themes = themes.unionByName(spark.createDataFrame(list(_THEMES.items()), "label string, theme string"))
    return symptoms.theme_impact(reviews(spark, sf), DET_COLS, themes)


@query("a19_tag_state", _R + ", s AS (SELECT det1 IN ({d}) IS TRUE OR det2 IN ({d}) IS TRUE AS d, del1 IN ({d}) IS TRUE OR del2 IN ({d}) IS TRUE AS l FROM reviews) SELECT CASE WHEN d AND l THEN 'full' WHEN d OR l THEN 'partial' ELSE 'none' END AS state, count(*) AS n FROM s GROUP BY 1".format(d=", ".join(f"'{k}'" for k in _CLEAN)))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return symptoms.tag_state(reviews(spark, sf), DET_COLS, DEL_COLS).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("a18_tag_edits", _R + """, c AS (SELECT list_filter([det1], lambda x: x IS NOT NULL) AS o, list_filter([det2], lambda x: x IS NOT NULL) AS n FROM reviews), z AS (SELECT sum(len(list_filter(n, lambda x: NOT list_contains(o, x)))) AS a, sum(len(list_filter(o, lambda x: NOT list_contains(n, x)))) AS r, sum(len(o)) AS t FROM c)
SELECT a::BIGINT AS added, r::BIGINT AS removed, t::BIGINT AS baseline_tags, (a + r)::BIGINT AS changed, round(greatest(0, (t - a - r) * 100.0 / t), 6) AS accuracy_pct FROM z""")  # fmt: skip
def a18(spark: SparkSession, sf: str) -> DataFrame:
    tags = lambda c: reviews(spark, sf).select(F.col("review_id").alias("key"), F.array_compact(F.array(F.col(f"`{c}`"))).alias("tags"))
    return symptoms.tag_edit_accuracy(tags(DET_COLS[0]), tags(DET_COLS[1]))


@query("f7_combined_filter", _R + "SELECT review_id, rating FROM reviews WHERE submission_time >= TIMESTAMP '1998-01-01' AND submission_time < TIMESTAMP '1999-01-01' AND rating IN (1, 5) AND retailer IN ('BUILDING', 'MACHINERY') AND NOT incentivized_review AND contains(lower(title_and_text), 'urgent') AND review_length_words BETWEEN 10 AND 40")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    spec = filters.FilterSpec("custom", start=date(1998, 1, 1), end=date(1998, 12, 31), stars=[1, 5], dimensions={"retailer": ["BUILDING", "MACHINERY"], "review_type": ["Organic"]}, extra={"review_length_words": {"kind": "number", "min": 10, "max": 40}}, keyword="Urgent")
    return filters.apply_review_filters(reviews(spark, sf), spec).select("review_id", "rating")


@query("f5_symptom_filter", _R + "SELECT review_id FROM reviews WHERE (det1 IN ('loud') OR det2 IN ('loud')) AND (del1 IN ('quiet') OR del2 IN ('quiet'))")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_symptoms(reviews(spark, sf), ["Loud"], ["Quiet"], DET_COLS, DEL_COLS).select("review_id")


@query("f8_action_filters", _R + "SELECT country, count(*) AS n FROM reviews WHERE NOT incentivized_review AND mapped_brand IN ('Brand#1', 'Brand#2') AND lower(moderation_status) IN ('approved', 'pending') GROUP BY 1")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prepared(spark, sf).withColumn("moderation_bucket", L.moderation_bucket("moderation_status"))
    return filters.apply_action_filters(rows, ["Approved", "Pending"], True, ["Brand#1", "Brand#2"]).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("f10_workspace", _R + "SELECT review_id, submission_time FROM reviews WHERE mapped_category IN ('PROMO') ORDER BY submission_time DESC, review_id DESC LIMIT 500")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return filters.load_workspace(reviews(spark, sf), 500, mapped_category=["PROMO"]).select("review_id", "submission_time")


@query("n11_n13_provenance", _R + """
SELECT CASE lower(moderation_status) WHEN 'approved' THEN 'Approved' WHEN 'pending' THEN 'Pending' WHEN 'rejected' THEN 'Rejected' ELSE 'Unknown' END AS bucket, CASE WHEN is_syndicated THEN 'Syndicated' WHEN incentivized_review OR campaign_id LIKE 'BVS%' THEN 'Seeded / Incentivized' ELSE 'Organic' END AS origin,
CASE WHEN campaign_id LIKE 'BVS%' THEN 'Sampling / TryIt' WHEN campaign_id LIKE 'bv_pie%' THEN 'Post-interaction email' WHEN campaign_id LIKE 'whol%' THEN 'Wholesale / Partner' ELSE 'Organic / Standard' END AS channel, count(*) AS n FROM reviews GROUP BY ALL""")  # fmt: skip
def n11(spark: SparkSession, sf: str) -> DataFrame:
    r = reviews(spark, sf)
    return r.groupBy(L.moderation_bucket("moderation_status").alias("bucket"), L.origin_group(F.col("incentivized_review"), F.col("is_syndicated"), "campaign_id").alias("origin"), L.acquisition_channel(F.col("incentivized_review"), "campaign_id").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("n16_regions", _R + "SELECT CASE right(content_locale, 2) WHEN 'CA' THEN 'Canada' WHEN 'FR' THEN 'France' WHEN 'US' THEN 'USA' WHEN 'GB' THEN 'UK' WHEN 'DE' THEN 'Germany' ELSE right(content_locale, 2) END AS region, count(*) AS n FROM reviews GROUP BY 1")
def n16(spark: SparkSession, sf: str) -> DataFrame:
    return reviews(spark, sf).groupBy(L.region_label("content_locale").alias("region")).agg(F.count(F.lit(1)).alias("n"))


_TURNS = "|".join(p.replace(" ", r"\s+") for p in sorted(L.CONTRAST, key=len, reverse=True))


@query("x1_fragments", rf"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS parts FROM s),
f AS (SELECT doc_id, flatten(list_transform(parts, lambda x: string_split_regex(trim(x, ' ,;'), '(?i)\s+(?:{_TURNS})\s+|[;•|–—]'))) AS pieces FROM p) SELECT doc_id, len(list_distinct(list_filter(list_transform(pieces, lambda x: trim(x, ' ,;')), lambda x: length(x) >= 8)))::INT AS n FROM f""")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(L.split_fragments("text")).alias("n"))


@query("t2_relevance", _T + """, s AS (SELECT review_id, rating, submission_time, lower(regexp_replace(title_and_text, '\\s+', ' ', 'g')) AS x, incentivized_review AS i, review_length_words AS w FROM texts),
z AS (SELECT review_id, rating, submission_time, """ + " + ".join(f"CASE WHEN contains(x, '{t}') THEN 3 ELSE 0 END + (length(x) - length(replace(x, '{t}', ''))) / {len(t)}" for t in ("broken", "thing", "broken")) + """ + coalesce(greatest(6 - rating, 0), 0) + CASE WHEN i THEN 0 ELSE 0.5 END + least(w / 60, 2) AS score FROM s),
p AS (SELECT * FROM (SELECT *, 0 AS part FROM z ORDER BY score DESC, submission_time DESC, review_id LIMIT 22) UNION ALL SELECT * FROM (SELECT *, 1 AS part FROM z WHERE rating BETWEEN 1 AND 2 ORDER BY submission_time DESC, review_id LIMIT 7) UNION ALL SELECT * FROM (SELECT *, 2 AS part FROM z WHERE rating BETWEEN 4 AND 5 ORDER BY submission_time DESC, review_id LIMIT 7)),
o AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY part) AS rn FROM p) SELECT review_id, round(score, 6) AS score FROM o WHERE rn = 1 ORDER BY part, o.score DESC, submission_time DESC, review_id LIMIT 22""")  # fmt: skip
def t2(spark: SparkSession, sf: str) -> DataFrame:
    return rank.select_relevant(review_texts(spark, sf), "broken thing with broken", 22).select("review_id", "score")


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old and new rows under ids that repeat."""
    r = reviews(spark, sf).select(F.col("order_line").alias("review_id"), "product_id", "review_text", "rating", F.col("review_id").alias("row_key"))
    return r.where("CAST(product_id AS LONG) % 2 = 0"), r.where("CAST(product_id AS LONG) % 2 = 1")


_TWO = "x AS (SELECT order_line AS review_id, product_id, review_text, rating, review_id AS row_key, product_id::BIGINT % 2 AS src FROM reviews)"


@query("j3_upsert", _R + f", {_TWO}, n AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY row_key DESC) AS rn FROM x WHERE src = 1) SELECT review_id, product_id, review_text, rating, row_key FROM x WHERE src = 0 AND review_id NOT IN (SELECT review_id FROM n) UNION ALL SELECT review_id, product_id, review_text, rating, row_key FROM n WHERE rn = 1")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert_reviews(*_two(spark, sf), ["row_key"])


@query("u1_merge_sources", _R + f", {_TWO}, y AS (SELECT * REPLACE (CASE WHEN review_id LIKE '%0-1' THEN 'review_' || substring(sha1(trim(product_id) || '|' || sha256(trim(review_text))), 1, 16) ELSE review_id END AS review_id) FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY review_id, product_id, review_text ORDER BY src, row_key) AS rn FROM y), m AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY src, row_key) AS n FROM k WHERE rn = 1) SELECT CASE WHEN n > 1 THEN review_id || ' (' || n || ')' ELSE review_id END AS review_id, product_id, review_text, rating, row_key, CASE WHEN src = 0 THEN 'shop.example' ELSE 'Unknown' END AS loaded_from_host, 'Link ' || (src + 1) AS loaded_from_batch FROM m")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    blank = lambda df: df.withColumn("review_id", F.when(F.col("review_id").like("%0-1"), " ").otherwise(F.col("review_id")))
    sources = [merge.loaded_from(blank(df), i, url) for i, (df, url) in enumerate(zip(_two(spark, sf), ("https://www.shop.example/reviews", ""), strict=True), 1)]
    return merge.merge_sources(sources, ["row_key"]).drop("loaded_from_url", "loaded_from_label")


@query("u2_merge_uploads", _R + f", {_TWO}, k AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY src, row_key) AS rn FROM x) SELECT review_id, product_id, review_text, rating, row_key FROM k WHERE rn = 1")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_uploads(list(_two(spark, sf)), ["row_key"])


def _sku_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a catalog: a third with their key as SKU, the rest with it as master item."""
    p, part = F.col("p_partkey"), table(spark, sf, "part")
    rows = part.select(F.when(p % 3 == 0, p.cast("string")).alias("SKU"), F.when(p % 3 == 1, (p % 500).cast("string")).alias("Master Item"), F.col("p_brand").alias("Brand"), F.col("p_type").alias("Category"), F.col("p_name").alias("Description"))
    return products.load_sku_catalog(rows)


@query("j1_enrich", _R + """, c AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END AS sku, CASE WHEN p_partkey % 3 = 1 THEN (p_partkey % 500)::VARCHAR END AS mi, p_brand AS b, p_type AS t, p_name AS n FROM part),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY b, t, sku, mi, n) AS rn FROM c WHERE sku IS NOT NULL) WHERE rn = 1), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mi ORDER BY b, t, sku, mi, n) AS rn FROM c WHERE mi IS NOT NULL) WHERE rn = 1)
SELECT r.review_id, CASE WHEN s1.sku IS NOT NULL THEN 'product_to_sku' WHEN s2.sku IS NOT NULL THEN 'base_to_sku' WHEN m1.mi IS NOT NULL THEN 'base_to_master' WHEN m2.mi IS NOT NULL THEN 'product_to_master' ELSE 'unmatched' END AS match_type, CASE WHEN s1.sku IS NOT NULL THEN s1.b WHEN s2.sku IS NOT NULL THEN s2.b WHEN m1.mi IS NOT NULL THEN m1.b ELSE m2.b END AS mapped_brand
FROM reviews r LEFT JOIN s s1 ON r.product_id = s1.sku LEFT JOIN s s2 ON r.base_sku = s2.sku LEFT JOIN m m1 ON r.base_sku = m1.mi LEFT JOIN m m2 ON r.product_id = m2.mi""")  # fmt: skip
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return products.enrich_with_catalog(reviews(spark, sf).drop("mapped_brand", "mapped_category", "mapped_subcategory", "base_model_number", "master_item"), _sku_catalog(spark, sf)).select("review_id", "match_type", "mapped_brand")


_TOP50 = "top AS (SELECT * FROM mentions ORDER BY engagement DESC, id LIMIT 50)"
_TOP4 = f"spikes AS (SELECT * REPLACE (CASE WHEN list_contains({social.CAUSES}, cause) THEN cause ELSE 'Unknown' END AS cause) FROM mentions ORDER BY velocity_pct DESC, engagement DESC, id LIMIT 4)"


@query("m1_posts", _M + f", {_TOP50} SELECT id, row_number() OVER (ORDER BY engagement DESC, id) AS rank, 'social' AS platform, platform AS source, platform AS headline, author, strftime(published, '%Y-%m-%d') AS submission_date, upper(sentiment[1]) || sentiment[2:] AS sentiment, reach AS views, engagement, velocity_pct, classification, cause, substring(trim(body), 1, 220) AS snippet FROM top")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return social.mention_posts(mentions(spark, sf)).select("id", "rank", "platform", "source", "headline", "author", "submission_date", "sentiment", "views", "engagement", "velocity_pct", "classification", "cause", "snippet")


@query("m2_fetch", _M + "SELECT id, published, engagement, reach FROM mentions WHERE published >= (SELECT max(published) FROM mentions) - INTERVAL 40 DAY AND platform IN ('click', 'view', 'purchase') AND sentiment IN ('positive', 'negative') ORDER BY reach DESC, id LIMIT 50")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    docs = mentions(spark, sf)
    last = docs.agg(F.max("published").cast("string")).first()[0] or "2000-01-01"
    return social.fetch_mentions(docs, last, 40, ["click", "view", "purchase"], ["positive", "negative"], "reach").select("id", "published", "metrics.engagement", "metrics.reach")


@query("m3_spikes", _M + f", {_TOP4} SELECT id, strftime(published, '%Y-%m-%d') AS date, cause, engagement, reach, pi_flag, velocity_pct::INT AS velocity_pct FROM spikes")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    return social.spike_events(mentions(spark, sf)).drop("title", "summary")


@query("m3_causes", _M + f", {_TOP4}, c AS (SELECT unnest({social.CAUSES}) AS cause), k AS (SELECT cause, count(*) AS n FROM spikes GROUP BY 1) SELECT cause, coalesce(n, 0)::BIGINT AS events, round_even(coalesce(n, 0) * 100.0 / greatest((SELECT count(*) FROM spikes), 1), 0)::INT AS share_pct FROM c LEFT JOIN k USING (cause)")
def m3b(spark: SparkSession, sf: str) -> DataFrame:
    return social.cause_breakdown(mentions(spark, sf))


_PAID = f"classification IN ('{social.EXPLICIT}', '{social.INFERRED}')"


@query("m4_paid_vs_organic", _M + f", {_TOP50} SELECT count(*) AS total, count(*) FILTER (NOT {_PAID}) AS organic, count(*) FILTER (classification = '{social.EXPLICIT}') AS incentivized_explicit, count(*) FILTER (classification = '{social.INFERRED}') AS incentivized_inferred, coalesce(round_even(avg(engagement) FILTER (NOT {_PAID}), 0), 0)::BIGINT AS organic_avg_engagement, coalesce(round_even(avg(engagement) FILTER ({_PAID}), 0), 0)::BIGINT AS incentivized_avg_engagement FROM top")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    return social.paid_vs_organic(mentions(spark, sf))


@query("m4_top_organic", _M + "SELECT id, platform AS title, engagement FROM mentions WHERE classification = 'ORGANIC' ORDER BY engagement DESC, id LIMIT 3")
def m4b(spark: SparkSession, sf: str) -> DataFrame:
    return social.top_organic(mentions(spark, sf)).select("id", "title", "engagement")


for _field, _n in (("positive_themes", 6), ("improvement_themes", 7)):

    @query(f"m5_{_field}", _M + f", e AS (SELECT id, trim(body) AS body, platform, engagement, unnest({_field}) AS theme FROM mentions) SELECT theme, count(*) AS mentions, round_even(count(*) * 100.0 / (SELECT count(*) FROM mentions), 0)::INT AS share_pct, substring((array_agg(body ORDER BY engagement DESC, id DESC))[1], 1, 160) AS best_quote, (array_agg(platform ORDER BY engagement DESC, id DESC))[1] AS quote_source, max(engagement) AS quote_engagement FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_n}")
    def m5(spark: SparkSession, sf: str, field: str = _field, n: int = _n) -> DataFrame:
        return social.theme_counts(mentions(spark, sf), field, n)


@query("m7_social_metrics", _M + f", {_TOP50}, {_TOP4} SELECT count(*) AS mentions, round_even(count(*) FILTER (sentiment = 'positive') * 100.0 / count(*), 0)::INT AS positive_pct, (SELECT count(*) FROM spikes) AS viral_posts, CASE WHEN (SELECT bool_or(pi_flag) FROM spikes) THEN 'High' ELSE 'Medium' END AS risk, round_even(count(*) FILTER (NOT {_PAID}) * 100.0 / count(*), 0)::INT AS organic_share_pct, 'social' AS top_platform FROM top")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    return social.social_metrics(mentions(spark, sf))
