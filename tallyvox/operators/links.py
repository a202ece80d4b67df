"""Links between labels: which may be alike at all, and what hangs together through them."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import plain_text


def held(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder; only a session whose tasks run in the driver's process may do without a named one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that it hangs together with.

    Each round a node takes the smallest root of its neighbours, then the root of its root, so long chains halve; rounds
    end when no root changes. A round is written, so nothing is computed twice. Links may repeat; links with a null end
    do not count.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = held(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    roots = held(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("next")), "other").groupBy("node").agg(F.min("next").alias("next"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "next").alias("least"))
        jump = roots.select(F.col("node").alias("least"), F.col("root").alias("far"))
        moved = held(lower.join(jump, "least").select("node", F.col("root").alias("before"), F.least("least", "far").alias("root")))
        changed = moved.where(F.col("before") != F.col("root")).limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots


def _grams(text: Column) -> Column:
    """Pairs of neighbouring characters with the number of times each has come before: (gram, n)."""
    pairs = F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))


def alike_candidates(labels: DataFrame, by: list[str], label: str, ratio: float) -> DataFrame:
    """(by, label_a, label_b), label_a < label_b: every pair of distinct labels of one group that may have a likeness of ratio or more, or of which one holds the other, by their plain text.

    With M characters in common blocks a pair of T characters has the likeness 2 M / T; there are at most T - 2 M + 1
    blocks, so the pair shares at least 3 M - T - 1 pairs of neighbouring characters. A label therefore meets others by
    its rarest pairs only: as many as it may lack, and one more. A label inside another shares all its pairs, so its
    rarest one meets it. Labels without letters or digits hold nothing and are in nothing; of one character they meet by it.
    """
    rows = labels.select(*by, F.col(label).alias("label")).distinct().withColumn("text", plain_text(F.col("label"))).where("text != ''").withColumn("n", F.length("text"))
    grams = rows.select(*by, "label", "text", "n", F.explode(F.when(F.col("n") == 1, F.array("text")).otherwise(F.concat(_grams(F.col("text")), F.array_distinct(F.split("text", ""))))).alias("gram")).where("gram != ''")
    often = grams.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("often"))
    each = grams.join(often, [*by, "gram"])
    long = each.where((F.length("gram") > 1) | (F.col("n") == 1))
    order = F.array_sort(F.collect_list(F.struct("often", "gram")))
    ordered = long.groupBy(*by, "label", "text", "n").agg(order.alias("grams"))
    least_total = F.col("n") + F.ceil(F.col("n") * (ratio / (2 - ratio)))  # of a pair that is alike enough
    shared = F.greatest(F.ceil(least_total * (1.5 * ratio - 1) - 1), F.lit(1))
    taken = F.greatest(F.size("grams") - shared + 1, F.lit(1)).cast("int")
    prefix = ordered.select(*by, "label", "text", "n", F.explode(F.slice(F.col("grams")["gram"], F.lit(1), taken)).alias("gram"))
    whole = each.select(*by, F.col("label").alias("other"), F.col("text").alias("other_text"), F.col("n").alias("m"), "gram")
    met = prefix.join(whole, [*by, "gram"]).where(F.col("label") != F.col("other"))
    total = F.col("n") + F.col("m")
    close = 2 * F.least("n", "m") >= ratio * total
    inside = (F.col("n") <= F.col("m")) & F.contains("other_text", F.col("text"))
    fit = met.where(close | inside)
    return fit.select(*by, F.least("label", "other").alias("label_a"), F.greatest("label", "other").alias("label_b")).distinct()


def least_shared(ratio: float, total: int) -> int:
    """The pairs of neighbouring characters that two texts of total characters share at least if their likeness is ratio."""
    m = math.ceil(ratio * total / 2 - 1e-9)
    return max(0, 3 * m - total - 1)
