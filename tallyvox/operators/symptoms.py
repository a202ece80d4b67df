"""Frequencies and star impact of symptom labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import OVERALL_LABELS, canonicalize_label, clean, clean_symptom, is_label, severity_weight


def symptom_array(cols: list[str], canonical: bool = True) -> Column:
    """The distinct valid labels in the slots of a row."""
    if not canonical:
        return F.array_distinct(F.array_compact(F.array(*[clean_symptom(c) for c in cols])))
    said = F.array_compact(F.array(*[F.when(is_label(c), clean(c)) for c in cols]))
    return F.array_distinct(F.transform(said, canonicalize_label))  # which makes the title case too


def _counted(df: DataFrame, cols: list[str]) -> DataFrame:
    """(star, labels, n): how many rows of each star have each set of labels. Rows are counted by what their slots say as it stands, so that wordings are worked out once for each set of slots."""
    slots = [f"_slot{i}" for i in range(len(cols))]
    sets = df.select(F.col("rating").alias("star"), *[F.col(c).alias(s) for c, s in zip(cols, slots, strict=True)]).groupBy("star", *slots).agg(F.count(F.lit(1)).alias("n"))
    return sets.select("star", symptom_array(slots).alias("labels"), "n").groupBy("star", "labels").agg(F.sum("n").alias("n"))


def symptom_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """label, mentions, pct_tagged, avg_star, avg_tags and weighted_mentions; the most mentioned first. Overall labels are left out, but reviews with them alone count as tagged."""
    counted = _counted(df, cols).where(F.size("labels") > 0).persist()  # a row for each set of labels and star
    tagged = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tagged"))
    long = counted.withColumn("labels", F.filter("labels", lambda x: ~x.isin(OVERALL_LABELS))).select("star", "n", F.size("labels").alias("tags"), F.explode("labels").alias("label"))
    n = F.col("n")
    by = long.groupBy("label").agg(F.sum("n").alias("mentions"), F.try_divide(F.sum(F.col("star") * n), F.sum(F.when(F.col("star").isNotNull(), n))).alias("avg_star"), (F.sum(F.col("tags") * n) / F.sum("n")).alias("avg_tags"), F.sum(n / F.col("tags")).alias("weighted_mentions"))
    out = by.crossJoin(F.broadcast(tagged)).withColumn("pct_tagged", F.bround(F.col("mentions") / F.col("tagged") * 100, 1)).drop("tagged")  # one row
    return out.orderBy(F.desc("mentions"), F.desc("weighted_mentions"), "label")


def _gap(star: Column, baseline: Column, kind: str) -> Column:
    return F.coalesce(F.greatest(star - baseline if kind == "delighters" else baseline - star, F.lit(0.0)), F.lit(0.0))


def _impact(by: DataFrame, label: str, kind: str, k: float, rounded: bool) -> DataFrame:
    """Net hit, forecast and impact from mentions, weighted, raw, avg_star, avg_tags, severity, tagged, total, baseline."""
    sign = 1 if kind == "delighters" else -1
    align = 0.45 + 0.55 * F.least(F.greatest(_gap(F.col("avg_star"), F.col("baseline"), kind) / 1.25, F.lit(0.0)), F.lit(1.0))
    confidence = F.sqrt(F.col("mentions") / (F.col("mentions") + max(k, 0.1)) * F.col("weighted") / (F.col("weighted") + max(k / 2, 0.5))) * align
    raw = sign * F.col("raw") / F.greatest("total", F.lit(1))
    out = by.withColumns({"_raw": raw, "net_hit": F.bround(raw, 3), "confidence": confidence}).withColumn("forecast", F.bround(F.col("net_hit" if rounded else "_raw") * F.col("confidence"), 3))
    out = out.withColumn("impact", F.bround(F.col("forecast") * F.col("severity"), 3))
    return out.select(
        label, "mentions", F.bround(F.col("mentions") / F.greatest("tagged", F.lit(1)) * 100, 1).alias("pct_tagged"), "avg_star", F.bround("avg_tags", 2).alias("avg_tags"),
        F.bround(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * 100, 1).alias("confidence_pct"), "net_hit", "forecast", "impact", F.col("severity").alias("severity"),
    ).orderBy(F.desc(F.greatest(F.abs("impact"), F.abs("forecast"), F.abs("net_hit"))), F.desc("mentions"), label)


def symptom_impact(df: DataFrame, cols: list[str], kind: str = "detractors", baseline: float | None = None, shrink_k: float = 3.0) -> DataFrame:
    """The share of the star average that each label accounts for, from rows; baseline: the average rating if not given.

    df is read once, down to counts by (label, star, number of labels); all sums over rows follow from these counts.
    """
    counted = _counted(df, cols).persist()  # a row for each set of labels and star
    average = F.coalesce(F.sum(F.col("star") * F.col("n")) / F.sum(F.when(F.col("star").isNotNull(), F.col("n"))), F.lit(0.0)) if baseline is None else F.max(F.lit(float(baseline)))
    facts = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), average.alias("baseline"), F.coalesce(F.sum(F.when(F.size("labels") > 0, F.col("n"))), F.lit(0)).alias("tagged"))
    kept = counted.withColumn("labels", F.filter("labels", lambda x: ~x.isin(OVERALL_LABELS)))
    rows = kept.select("star", "n", F.size("labels").alias("tags"), F.explode("labels").alias("label")).crossJoin(F.broadcast(facts))  # one row of facts
    weight, n = F.col("n") / F.col("tags"), F.col("n")
    gap = _gap(F.col("star"), F.col("baseline"), kind)
    by = rows.groupBy("label", "total", "baseline", "tagged").agg(
        F.sum("n").alias("mentions"), F.try_divide(F.sum(F.col("star") * n), F.sum(F.when(F.col("star").isNotNull(), n))).alias("avg_star"), (F.sum(F.col("tags") * n) / F.sum("n")).alias("avg_tags"), F.sum(weight).alias("weighted"), F.sum(weight * gap).alias("raw")
    )
    return _impact(by.withColumn("severity", severity_weight("label", kind)), "label", kind, shrink_k, rounded=True)


def symptom_impact_of_table(table: DataFrame, total: int, baseline: float, kind: str = "detractors", shrink_k: float = 3.0) -> DataFrame:
    """Impact from a symptom table alone (label, mentions, avg_star, and pct_tagged and avg_tags if it has them), where the rows behind it are gone."""
    sign, k = (1 if kind == "delighters" else -1), max(shrink_k, 0.1)
    gap = _gap(F.col("avg_star"), F.lit(float(baseline)), kind)
    align = 0.45 + 0.55 * F.least(gap / 1.25, F.lit(1.0))
    out = table.withColumns({"severity": severity_weight("label", kind), "confidence": F.col("mentions") / (F.col("mentions") + k) * align, "net_hit": F.bround(sign * F.col("mentions") / max(total, 1) * gap, 3)})
    out = out.withColumn("forecast", F.bround(F.col("net_hit") * F.col("confidence"), 3)).withColumn("impact", F.bround(F.col("forecast") * F.col("severity"), 3))
    own = [c for c in ("pct_tagged", "avg_tags") if c in table.columns]
    return out.select("label", "mentions", *own, "avg_star", F.bround(F.col("confidence") * 100, 1).alias("confidence_pct"), "net_hit", "forecast", "impact", "severity").orderBy(F.desc(F.greatest(F.abs("impact"), F.abs("forecast"), F.abs("net_hit"))), F.desc("mentions"), "label")


def attach_theme(long: DataFrame, themes: DataFrame) -> DataFrame:
    """long with the theme of its label, Product Specific if it has none."""
    return long.join(themes, "label", "left").withColumn("theme", F.coalesce("theme", F.lit("Product Specific")))


def theme_impact(df: DataFrame, cols: list[str], themes: DataFrame, kind: str = "detractors", shrink_k: float = 3.0) -> DataFrame:
    """Impact by theme: labels of a theme count once in a review, with the sum of their weights. df is read once, as for symptom_impact."""
    counted = _counted(df, cols).persist()  # a row for each set of labels and star
    average = F.coalesce(F.sum(F.col("star") * F.col("n")) / F.sum(F.when(F.col("star").isNotNull(), F.col("n"))), F.lit(0.0))
    facts = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), average.alias("baseline"), F.coalesce(F.sum(F.when(F.size("labels") > 0, F.col("n"))), F.lit(0)).alias("tagged"))
    kept = counted.select("star", "n", F.filter("labels", lambda x: ~x.isin(OVERALL_LABELS)).alias("labels"), F.col("labels").alias("set"))
    long = kept.select("star", "n", "set", F.size("labels").alias("tags"), F.explode("labels").alias("label"))
    rows = attach_theme(long, themes).withColumn("severity", severity_weight("label", kind))
    per = rows.groupBy("star", "n", "set", "theme").agg(F.max("tags").alias("tags"), F.sum(1 / F.col("tags")).alias("weight"), F.avg("severity").alias("severity"))
    per = per.crossJoin(F.broadcast(facts)).withColumn("gap", _gap(F.col("star"), F.col("baseline"), kind))  # one row of facts
    n = F.col("n")
    by = per.groupBy("theme", "total", "baseline", "tagged").agg(
        F.sum("n").alias("mentions"), F.try_divide(F.sum(F.col("star") * n), F.sum(F.when(F.col("star").isNotNull(), n))).alias("avg_star"), (F.sum(F.col("tags") * n) / F.sum("n")).alias("avg_tags"), F.sum(F.col("weight") * n).alias("weighted"), F.sum(F.col("weight") * F.col("gap") * n).alias("raw"), (F.sum(F.col("severity") * n) / F.sum("n")).alias("severity")
    )
    return _impact(by, "theme", kind, shrink_k, rounded=False)


def tag_edit_accuracy(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: added, removed, changed tags against the baseline (key, tags) and the accuracy, 0 at least."""
    old, new = baseline.select("key", F.col("tags").alias("old")), current.select("key", F.col("tags").alias("new"))
    none = F.array().cast("array<string>")
    both = old.join(new, "key", "full_outer").select(F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = both.agg(total(F.size(F.array_except("new", "old"))).alias("added"), total(F.size(F.array_except("old", "new"))).alias("removed"), total(F.size("old")).alias("baseline_tags"))
    return out.withColumns({"changed": F.col("added") + F.col("removed"), "accuracy_pct": F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("baseline_tags") - F.col("added") - F.col("removed")) * 100.0, F.col("baseline_tags")), F.lit(100.0)))})


def tag_state(df: DataFrame, det_cols: list[str], del_cols: list[str], id_col: str = "review_id") -> DataFrame:
    """Per row whether it has labels of either side and what it needs, and the state: full, partial or none."""
    has = lambda cols: F.size(F.array_compact(F.array(*[clean_symptom(c) for c in cols]))) > 0
    out = df.select(id_col, has(det_cols).alias("has_detractors"), has(del_cols).alias("has_delighters"))
    both, some = F.col("has_detractors") & F.col("has_delighters"), F.col("has_detractors") | F.col("has_delighters")
    return out.withColumns({"needs_detractors": ~F.col("has_detractors"), "needs_delighters": ~F.col("has_delighters"), "state": F.when(both, "full").when(some, "partial").otherwise("none")})
