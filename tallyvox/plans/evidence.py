"""Registered queries over label packs, catalogs, evidence and the retailer watch, each with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.audit import label_counts
from .catalog import _M, _R, _T, Query, six
from .catalog import ORACLE_SQL as CATALOG_SQL
from .reports import _TAGS, counted_tags, labels
from .reviews import DEL_COLS, DET_COLS, mentions, review_texts, reviews

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PACK = [
    ("Loud Noise", "detractor", ["thing", "loud"]), ("Never Said Here", "detractor", []), ("Breaks Early", "detractor", ["broken", "break"]),
    ("Steel", "delighter", ["steel"]), ("Good Value", "delighter", ["the value", "good"]),
]
REGION = "CASE right(content_locale, 2) WHEN 'CA' THEN 'Canada' WHEN 'FR' THEN 'France' WHEN 'US' THEN 'USA' WHEN 'GB' THEN 'UK' WHEN 'DE' THEN 'Germany' ELSE right(content_locale, 2) END"


def query(name: str, sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: six(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return add


def _hits(i: int, label: str, side: str, aliases: list[str]) -> str:
    said = " OR ".join(f"contains(x, '{p.lower()}')" for p in (label, *aliases))
    return f"SELECT {i} AS position, '{label}' AS label, '{side}' AS side, count(*) FILTER ({said}) AS hits FROM s"


@query("a27_supported_pack", _T.rstrip() + ", s AS (SELECT regexp_replace(lower(trim(review_text)), '\\s+', ' ', 'g') AS x FROM texts), h AS (" + " UNION ALL ".join(_hits(i, *p) for i, p in enumerate(PACK)) + ") SELECT position, label, side, hits FROM h WHERE hits >= 1")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.supported_pack(review_texts(spark, sf), PACK)


def _watched(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_rows(reviews(spark, sf), "retailer", "content_locale", "submission_time", "incentivized_review", organic_only=True)


_WATCH = _R.rstrip() + f", w AS (SELECT retailer AS Retailer, {REGION} AS Region, submission_time AS date, rating FROM reviews WHERE NOT incentivized_review) "


@query("a30_watch_table", _WATCH + "SELECT Retailer, Region, count(*) AS Reviews, round(avg(rating), 6) AS Avg FROM w GROUP BY 1, 2")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_table(_watched(spark, sf))


@query("a30_watch_kpis", _WATCH + "SELECT CASE WHEN grouping(Region) = 1 THEN 'All selected' ELSE Region END AS Region, count(*) AS reviews, round(avg(rating), 6) AS avg_rating FROM w GROUP BY ROLLUP (Region)")
def a30b(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_kpis(_watched(spark, sf))


@query("a30_watch_trend", _WATCH + "SELECT Retailer, Region, date_trunc('week', date)::TIMESTAMP AS week, count(*) AS reviews, round(avg(rating), 6) AS avg_rating FROM w WHERE date IS NOT NULL GROUP BY 1, 2, 3")
def a30c(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.watch_trend(_watched(spark, sf))


@query("x17_prune_catalog", _TAGS + """, k AS (SELECT concat_ws('/', side, label) AS label, row_number() OVER (ORDER BY concat_ws('/', side, label)) AS position, coalesce(c, 0) AS n FROM labels LEFT JOIN hits USING (label, side)), f AS (SELECT *, round_even(sum(n) OVER () / count(*) OVER (), 0) >= 30 AS known FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN known THEN -n END, position) AS place FROM f) SELECT label, n, place, CASE WHEN place <= 6 AND (NOT known OR n > 0) THEN 'primary' ELSE 'extended' END AS tier FROM r""")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    counts = label_counts(counted_tags(spark, sf))
    named = lambda df: df.withColumn("label", F.concat_ws("/", "side", "label"))
    catalog = named(labels(spark)).selectExpr("label", "row_number() OVER (ORDER BY label) AS position")
    return evidence.prune_catalog(catalog, named(counts), max_labels=6)


@query("i13_taxonomy", _TAGS + "SELECT DISTINCT side, label, 0 AS aliases FROM tl")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.load_taxonomy(reviews(spark, sf), DET_COLS, DEL_COLS).withColumn("aliases", F.size("aliases"))


@query("t3_evidence_pack", _T.rstrip() + f""", rel AS ({CATALOG_SQL['t2_relevance']}), p AS (SELECT review_id, 0 AS part FROM rel UNION ALL (SELECT review_id, 1 FROM texts ORDER BY submission_time DESC, review_id LIMIT 10)
UNION ALL (SELECT review_id, 2 FROM texts WHERE rating IN (1, 2) ORDER BY submission_time DESC, review_id LIMIT 8) UNION ALL (SELECT review_id, 3 FROM texts WHERE rating IN (4, 5) ORDER BY submission_time DESC, review_id LIMIT 8)),
o AS (SELECT review_id, min(part)::INT AS part FROM p GROUP BY 1) SELECT review_id, part, substring(review_text, 1, 600) AS snippet FROM o JOIN texts USING (review_id) ORDER BY part, submission_time DESC, review_id LIMIT 32""")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.evidence_pack(review_texts(spark, sf), "broken thing with").select("review_id", "part", "snippet")


@query("m6_use_cases", _M + """, h AS (SELECT *, CASE WHEN velocity_pct > 40 THEN cause END AS hack FROM mentions)
SELECT hack AS use_case, count(*) AS post_count, substring((array_agg(body ORDER BY engagement DESC, id DESC))[1], 1, 160) AS representative_quote, (array_agg(platform ORDER BY engagement DESC, id DESC))[1] AS quote_source, max(engagement) AS quote_engagement, CASE WHEN max(engagement) >= 9000 THEN 'high' ELSE 'medium' END AS novelty FROM h WHERE hack <> '' GROUP BY 1""")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    docs = mentions(spark, sf).withColumns({"hack_name": F.when(F.col("velocity_pct") > 40, F.col("cause")), "hack_implications": F.array().cast("array<string>")})
    return evidence.use_cases(docs).drop("implications")
