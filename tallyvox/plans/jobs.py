"""Registered queries that run whole jobs over the given tables: files in and out, and streams, each with SQL for the same result."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.csv_files import read_csv_files
from ..streaming import merge_table, streams, timed
from .catalog import Query, six
from .reports import _TAGS, _work, labels, tags
from .reviews import table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: six(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return add


@contextmanager
def typed_state(spark: SparkSession):  # noqa: ANN201
    """For a stream with timers: the state store that it needs, while it runs."""
    name, provider = timed.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stream(spark: SparkSession, sf: str, name: str, **options: int) -> DataFrame:
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(f"{sf}/{name}.parque[t]")  # as a pattern it may be a file or a folder


#: Texts whose characters Latin-1 has.
_LATIN = "^[\\x00-\\xFF]*$"


_LATIN_SQL = f"(doc_id % 3 = 2 AND regexp_matches(text, '{_LATIN}'))"


@query("i1_csv_files", f"""SELECT doc_id::VARCHAR AS review_id, sha256(text) AS text_sha256, length(text) AS n_chars, CASE WHEN doc_id % 3 <> 1 THEN source END AS source, CASE WHEN doc_id % 3 <> 1 AND NOT {_LATIN_SQL} THEN lang END AS lang,
CASE WHEN {_LATIN_SQL} THEN 'latin' WHEN doc_id % 3 = 1 THEN 'short' ELSE 'full' END AS layout FROM documents WHERE text <> ''""")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as CSV files of three layouts (order and number of columns, encoding), in one folder, and read back."""
    folder, docs = _work(spark), table(spark, sf, "documents").where("text <> ''")
    third = F.col("doc_id") % 3
    layout = F.when((third == 2) & F.col("text").rlike(_LATIN), "latin").when(third == 1, "short").otherwise("full")
    named = docs.select(layout.alias("layout"), F.col("doc_id").alias("Review ID"), F.col("text").alias("Review Text"), F.col("source").alias("Source"), F.col("lang").alias("Locale"))
    shapes = {"latin": (["Source", "Review ID", "layout", "Review Text"], "ISO-8859-1"), "short": (["Review Text", "layout", "Review ID"], "UTF-8"), "full": (["Review ID", "Review Text", "Source", "Locale", "layout"], "UTF-8")}
    options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for name, (columns, encoding) in shapes.items():
        named.where(F.col("layout") == name).select(*columns).write.options(**options, encoding=encoding).csv(f"{folder}/{name}")
    rows = read_csv_files(spark, [f"{folder}/{name}" for name in shapes])
    return rows.select(F.col("Review ID").alias("review_id"), F.sha2("Review Text", 256).alias("text_sha256"), F.length("Review Text").alias("n_chars"), F.col("Source").alias("source"), F.col("Locale").alias("lang"), "layout")


@query("s2_stream_upsert", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey::VARCHAR AS review_id, o_orderkey AS order_id, o_orderstatus AS status FROM r WHERE rn = 1 AND o_orderstatus <> 'P'""")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each customer, kept by a stream; a last order of status P takes the customer out."""
    folder = _work(spark)
    orders = _stream(spark, sf, "orders", maxFilesPerTrigger=1000)
    rows = orders.select(F.col("o_custkey").cast("string").alias("review_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_orderdate", (F.col("o_orderstatus") == "P").alias(merge_table.DELETED))
    merge_table.stream_upsert(rows, f"{folder}/table", ["o_orderdate", "order_id"], f"{folder}/log", buckets=8).awaitTermination()
    return merge_table.read_table(spark, f"{folder}/table").drop("o_orderdate")


_CLOSED = "(SELECT max(o_orderdate) FROM orders) - INTERVAL 40 DAY"


@query("s3_stream_last", f"SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND o_orderdate <= {_CLOSED}")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each customer without an order for 20 days, given out once by a stream whose watermark is 20 days behind."""
    folder = _work(spark)
    rows = _stream(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    with typed_state(spark):
        streams.run_appends(timed.stream_last(rows, ["o_custkey"], ["at", "o_orderkey"], 20 * 86_400, "at").drop("at"), f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("s4_stream_months_once", """SELECT * FROM (SELECT l_returnflag, date_trunc('month', l_shipdate)::TIMESTAMP AS period_start, count(*)::DOUBLE AS n, round(sum(l_quantity), 6)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2)
WHERE period_start + INTERVAL 1 MONTH <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY""")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments by flag and month, each month given out once when the watermark has passed it."""
    folder = _work(spark)
    rows = _stream(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.col("l_shipdate").cast("timestamp").alias("at"))
    with typed_state(spark):
        streams.run_appends(timed.stream_months(rows, ["l_returnflag"], ["l_quantity"], "30 days", "at"), f"{folder}/out", f"{folder}/log")
    return spark.read.parquet(f"{folder}/out").select("l_returnflag", "period_start", "n", F.col("sum_l_quantity").alias("quantity"))


@query("s5_label_tracker", _TAGS + """SELECT label, side, issue, pct, count FROM (SELECT label, side, CASE WHEN coalesce(c, 0) / total > 0.45 THEN 'too_broad' WHEN coalesce(c, 0) = 0 AND total >= 20 THEN 'zero_hits' END AS issue, round_even(coalesce(c, 0) / total * 100, 1) AS pct, coalesce(c, 0) AS count FROM labels LEFT JOIN hits USING (label, side), n WHERE total >= 15) WHERE issue IS NOT NULL
UNION ALL SELECT '(overall)', 'both', 'high_zero_rate', round_even(u / total * 100, 1), u FROM (SELECT count(*) FILTER (len(dets) + len(dels) = 0) AS u, count(*) AS total FROM tags) WHERE total >= 15 AND u / total > 0.5""")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """The standing alerts of a tracker that has followed the tags of all reviews, in several batches."""
    folder = _work(spark)
    rows = tags(spark, sf).select("key", "dets", "dels", "ev_det", "ev_del")
    rows.withColumn("third", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int")).write.partitionBy("third").parquet(f"{folder}/in")  # each task writes its own rows
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    source = spark.readStream.schema(rows.withColumn("third", F.lit(0)).schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{folder}/in").drop("third")
    streams.stream_label_tracker(source, labels(spark), f"{folder}/out", f"{folder}/log").awaitTermination()
    return streams.standing_alerts(spark, f"{folder}/out").select("label", "side", "issue", "pct", "count")
