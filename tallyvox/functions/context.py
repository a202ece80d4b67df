"""The text of a review with what its other fields say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import let, single_spaced

#: Fields that come first, and parts of names that keep a column out.
FIRST = [
    "title", "review_text", "pros", "cons", "headline", "body", "comments", "reviewer_comments", "usage_context", "routine", "variant", "size", "color", "flavor", "scent",
    "style", "fit", "material", "attachments", "accessories",
]
LEFT_OUT = ["symptom", "ai ", "needs_", "has_", "rating", "review_id", "submission", "locale", "product_id", "sku", "token", "score"]
LONGEST = 400


def review_context(df: DataFrame) -> Column:
    """title_and_text, then the first fields and then other columns (3 characters at least, cut at 400) as Field: value, on lines that say nothing twice.

    Values are compared without regard to case. Null and blank values are left out; a row without any gives an empty text.
    """
    spaced = lambda c: F.trim(single_spaced(F.coalesce(c.cast("string"), F.lit(""))))
    simple = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    named = {c.lower(): c for c in simple}
    parts = [("", spaced(F.col("title_and_text")))] if "title_and_text" in simple else []
    parts += [(f, spaced(F.col(f"`{named[f]}`"))) for f in FIRST if f in named]
    for c in simple:
        low = c.lower()
        if low == "title_and_text" or low in FIRST or any(mark in low for mark in LEFT_OUT):
            continue
        value = spaced(F.col(f"`{c}`"))
        parts.append((c, F.when(F.length(value) >= 3, F.trim(F.substring(value, 1, LONGEST))).otherwise("")))
    rows = F.filter(F.array(*[F.struct(F.lit(" ".join(w.capitalize() for w in n.replace("_", " ").split())).alias("name"), v.alias("value")) for n, v in parts]), lambda x: x["value"] != "")
    line = lambda x: F.when(x["name"] == "", x["value"]).otherwise(F.concat(x["name"], F.lit(": "), x["value"]))
    once = lambda rows, keys: F.filter(F.transform(rows, lambda x, i: F.when(F.array_position(keys, F.lower(x["value"])) == i + 1, line(x))), lambda x: x.isNotNull())
    return let(rows, lambda r: let(F.transform(r, lambda x: F.lower(x["value"])), lambda keys: F.array_join(once(r, keys), "\n")))
