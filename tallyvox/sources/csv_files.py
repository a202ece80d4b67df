"""CSV files that differ: each is read by its own header and its own encoding, and all meet by column name.

A catalogue of the files comes first, in two light passes over lines: whether all bytes of a file are UTF-8, and its
first lines. Files of equal header and encoding are read together, in parallel, and the reads are united by name.
"""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.labels import blank_to_null

#: Lines over which a header may reach, by line ends in quotes.
HEADER_LINES = 64
#: The encoding of files whose bytes are not all UTF-8.
ELSE_ENCODING = "ISO-8859-1"
_BOM = "﻿"
_RAW = "_raw_record"


@dataclass(frozen=True)
class Layout:
    """How some files are read: their encoding and their column names by position."""

    encoding: str
    names: tuple[str, ...]


def file_catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, is_utf8, lines, first_lines) of each file that has a line; first_lines are the bytes of up to HEADER_LINES lines.

    Line ends are no part of a UTF-8 sequence, so a file is valid if its lines are. Both facts come from partial
    aggregates: a task sends a row for each file and at most HEADER_LINES lines of it, whatever the files' size.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"), F.count(F.lit(1)).alias("lines"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    first = lines.where("start = 0").withColumn("n", n).where(F.col("n") <= HEADER_LINES)
    first = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", F.col("value").cast("binary").alias("value")))).alias("f"))
    return valid.join(first, "path").select("path", "is_utf8", "lines", F.col("f")["value"].alias("first_lines"))


def header_names(first_lines: list[bytes], lines: int, encoding: str) -> tuple[str, ...]:
    """The trimmed names of a file's first record; a blank one is named by its place, as "Unnamed: 2"."""
    text = b"\n".join(bytes(x) for x in first_lines).decode(encoding).removeprefix(_BOM)
    reader = csv.reader(io.StringIO(text, newline=""))
    record = next(reader, [])
    if reader.line_num == len(first_lines) < lines and len(first_lines) == HEADER_LINES:
        raise ValueError(f"a header reaches over more than {HEADER_LINES} lines")
    return tuple(name.strip() or f"Unnamed: {i}" for i, name in enumerate(record))


def layouts(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> dict[Layout, list[str]]:
    """The files of each layout, by path. The driver gets a row a file, as it does when Spark lists them."""
    out: dict[Layout, list[str]] = defaultdict(list)
    for r in file_catalogue(spark, paths).orderBy("path").collect():
        own = encoding or ("UTF-8" if r["is_utf8"] else ELSE_ENCODING)
        out[Layout(own, header_names(r["first_lines"], r["lines"], own))].append(unquote(r["path"]))  # Spark says paths as URLs
    return dict(out)


def _literal(path: str) -> str:
    """path with the marks of patterns escaped, so that it means this file only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _by_place(spark: SparkSession, layout: Layout, files: list[str], raw: bool) -> DataFrame:
    """Records as _c0, _c1 and so on; with raw, beside them the text of a record that has more or fewer fields than the header."""
    fields = [StructField(f"_c{i}", StringType()) for i in range(len(layout.names))]
    schema = StructType(fields + [StructField(_RAW, StringType())] * raw)
    reader = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding=layout.encoding, mode="PERMISSIVE")
    if raw:
        reader = reader.options(columnNameOfCorruptRecord=_RAW, columnPruning=False)
    return reader.csv([_literal(f) for f in files])


def _named(layout: Layout) -> list[Column]:
    """A column for each name, whatever its case; of columns with the same name the first value from the left that is not blank."""
    places: dict[str, list[int]] = defaultdict(list)
    for i, name in enumerate(layout.names):
        places[name.lower()].append(i)
    pick = lambda at: F.col(f"_c{at[0]}") if len(at) == 1 else F.coalesce(*[blank_to_null(f"_c{i}") for i in at])
    return [pick(at).alias(layout.names[at[0]]) for at in places.values()]


def file_name() -> Column:
    """The name of the file that a row is read from; Spark says it as in a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _united(spark: SparkSession, paths: str | list[str], encoding: str | None, read: Callable[[Layout, list[str]], DataFrame]) -> DataFrame | None:
    found = layouts(spark, paths, encoding)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(*x) for x in found.items()]) if found else None


def read_csv_files(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """The records of CSV files as text columns, united by column name, with source_file and an order of rows (_ord).

    Fields may be quoted and hold line ends; a quote in one is doubled. A file is UTF-8 where all its bytes are, else
    Latin-1, unless an encoding is named; a mark at its start (BOM) is no part of the first header. A column that a file
    lacks is null there. A record with too few fields ends in nulls, one with too many loses the last; both are listed
    by odd_records(). Files without a line give nothing; without any file with a line the result has no other columns.
    """
    mark = file_name().alias("source_file")
    rows = _united(spark, paths, encoding, lambda layout, files: _by_place(spark, layout, files, False).select(*_named(layout), mark))
    if rows is None:
        rows = spark.createDataFrame([], "source_file string")
    return rows.withColumn("_ord", F.monotonically_increasing_id())


def odd_records(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """(source_file, n_columns, fields, record): the records whose number of fields is not that of their file's header, as they were read and as they stand there."""
    rows = _united(
        spark, paths, encoding, lambda layout, files: _by_place(spark, layout, files, True).where(F.col(_RAW).isNotNull()).select(file_name().alias("source_file"), F.lit(len(layout.names)).alias("n_columns"), F.array(*[f"_c{i}" for i in range(len(layout.names))]).alias("fields"), F.col(_RAW).alias("record"))
    )
    return spark.createDataFrame([], "source_file string, n_columns int, fields array<string>, record string") if rows is None else rows
