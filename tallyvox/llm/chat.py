r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one text of turns, each "### role: text</turn>" and a line end. The grammar is deterministic: a
turn ends at the first "</turn>" and line end, its role at the first ": ", and neither "### " nor "</turn>" stands in a
text. Each turn is
rendered as it is and parsed again; where the parser does not give back the same role and text, the conflicting strings
are escaped. An escape puts one backslash into the string ("### " becomes "###\ ", "</turn>" becomes "<\/turn>", ": "
in a role becomes ":\ ") and one more where some stand there already; the parser takes one out, so nothing is lost.
Every part of a conversation is parsed once more and compared with its source before it is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER, END, AFTER_ROLE = "### ", "</turn>\n", ": "
#: The control strings as (before the backslashes, after them, the regular expression of each).
CONTROLS = [("###", " "), ("<", "/turn>")]
ROLE_CONTROLS = [*CONTROLS, (":", " ")]
#: Turns whose numbers share this quotient are rendered and checked together; a long conversation is many such parts.
PART_TURNS = 64


def escape(text: Column, controls: list[tuple[str, str]]) -> Column:
    """text with one backslash more inside every control string; none is left."""
    for before, after in controls:
        text = F.regexp_replace(text, rf"{before}(\\*){after}", rf"{before}\\$1{after}")
    return text


def unescape(text: Column, controls: list[tuple[str, str]]) -> Column:
    """The inverse of escape()."""
    for before, after in controls:
        text = F.regexp_replace(text, rf"{before}\\(\\*){after}", rf"{before}$1{after}")
    return text


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEADER), role, F.lit(AFTER_ROLE), body, F.lit(END))


def pieces(formatted: Column | str) -> Column:
    """The rendered turns without their ends; null where the text does not end with a turn's end."""
    cut = F.split(formatted, END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1))


def _turn(piece: Column) -> Column:
    """The role and text of a rendered turn; null if it does not follow the grammar."""
    head = F.substring_index(piece, AFTER_ROLE, 1)
    body = F.substr(piece, F.length(head) + len(AFTER_ROLE) + 1)
    fits = piece.startswith(HEADER) & F.contains(piece, F.lit(AFTER_ROLE)) & (F.locate(HEADER, piece, len(HEADER) + 1) == 0) & ~F.contains(piece, F.lit(END.strip()))
    return F.when(fits, F.struct(unescape(F.substr(head, F.lit(len(HEADER) + 1)), ROLE_CONTROLS).alias("role"), unescape(body, CONTROLS).alias("text")))


def parse(formatted: Column | str) -> Column:
    """The turns of a formatted conversation, as an array of (role, text); null for a turn or a text outside the grammar."""
    return F.transform(pieces(formatted), _turn)


def rendered_turns(turns: DataFrame) -> DataFrame:
    """turns (role, text) with piece, the rendered turn that parses back to the same role and text, and body, its text in there."""
    same = lambda piece: F.coalesce(parse(piece) == F.array(F.struct("role", "text")), F.lit(False))
    asis = turns.withColumn("fits", same(render(F.col("role"), F.col("text"))))
    of = lambda name, controls: F.when(F.col("fits"), F.col(name)).otherwise(escape(F.col(name), controls))
    return asis.select(*turns.columns, of("role", ROLE_CONTROLS).alias("said_role"), of("text", CONTROLS).alias("body")).withColumn("piece", render(F.col("said_role"), F.col("body")))


def format_conversations(conversations: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and loss_spans, an array of (turn, offset, start, length).

    conversations has conv_id, turn, role and text; other columns are ignored, whatever their names. Turns stand by
    number, a null number last, ties by role and text; repeated rows are turns each. A null role or text is empty, rows
    without conv_id are one conversation. A span is the text of a turn whose role is learn_from, in code points:
    turn counts from 0, offset is its place in the rendered turn, start that in formatted. An empty table has no rows.

    Turns are rendered in parts of PART_TURNS numbers, so the parsing of a very long conversation is shared by many
    tasks; its text in the end is one value of one row, which Spark holds up to 2 GB.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.floor(F.col("turn") / PART_TURNS))
    by_turn = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_last("turn"), "role", "text")
    before = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    body_at = F.length("piece") - F.length("body") - len(END)
    held = rendered_turns(turns).select(
        "conv_id", "part", "role", "text", "piece", F.row_number().over(by_turn).alias("n"), F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).alias("at"), body_at.alias("offset"), F.length("body").alias("length")
    )
    turn = F.struct("n", "piece", "role", "text", "at", "offset", "length")
    parts = held.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns")).withColumn("formatted", F.array_join(F.col("turns")["piece"], ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    identical = F.coalesce(parse("formatted") == source, F.lit(False))
    parts = parts.withColumn("formatted", F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns"))))
    by_part = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "turns", "formatted", F.coalesce(F.sum(F.length("formatted")).over(by_part), F.lit(0)).alias("start"), F.coalesce(F.sum(F.size("turns")).over(by_part), F.lit(0)).alias("first"))
    learned = F.filter("turns", lambda t: t["role"] == learn_from)
    spans = F.transform(learned, lambda t: F.struct((F.col("first") + t["n"] - 1).cast("long").alias("turn"), t["offset"].cast("long").alias("offset"), (F.col("start") + t["at"] + t["offset"]).cast("long").alias("start"), t["length"].cast("long").alias("length")))
    parts = parts.select("conv_id", F.struct(F.col("part").isNull(), "part", "formatted", F.size("turns").alias("n"), spans.alias("spans")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"), F.array_join(F.col("parts")["formatted"], "").alias("formatted"), F.flatten(F.col("parts")["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from formatted and loss_spans alone.

    turns_sha256 is over role, line end, text, line end of each parsed turn; loss_sha256 over the unescaped text that
    the spans mark.
    """
    cut = formatted.select("conv_id", "formatted", "loss_spans", pieces("formatted").alias("pieces"))
    turns = F.transform("pieces", _turn)
    learned = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at(F.col("pieces"), (s["turn"] + 1).cast("int")), s["offset"] + 1, s["length"]), CONTROLS))
    read = cut.select("conv_id", "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


#: A conversation that holds the template's own strings: user and assistant both say this.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) and the two turns of PROBE_ID."""
    rows = [(PROBE_ID, i, role, PROBE) for i, role in enumerate(("user", "assistant"))]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def oracle() -> str:
    """The result of op12 in SQL."""
    role, body = "role", "text"
    for before, after in CONTROLS:
        body = f"regexp_replace({body}, '{before}(\\\\*){after}', '{before}\\\\\\1{after}', 'g')"
    for before, after in ROLE_CONTROLS:
        role = f"regexp_replace({role}, '{before}(\\\\*){after}', '{before}\\\\\\1{after}', 'g')"
    order = "ORDER BY turn NULLS LAST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT {PROBE_ID}, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
l AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order}) AS learned, string_agg(role || chr(10) || text || chr(10), '' {order}) AS said, count(*) AS n_turns,
sum({len(HEADER) + len(AFTER_ROLE) + len(END)} + length({role}) + length({body}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM l
"""
