"""From raw documents to packed training sequences, in five stages; part of tallyvox.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of docs, whatever they are; they judge a row by its text, so null and empty texts, ties and repeated rows need
no special case but where a stage says so. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.llm import decontaminate, near_dup, packing, quality, toxicity
from tallyvox.llm.common import labelled_rows, labelled_sample, shared_folder, table
from tallyvox.llm.queries import TRAIN_PER_CLASS, default_tokenizer


def both_labels(spark: SparkSession, docs: DataFrame, sf_dir: str, label: str, modulus: int, held_out: int) -> bool:
    """Whether the rows that a classifier may learn from are of both labels."""
    found = labelled_rows(docs, table(spark, sf_dir, "labels"), label, modulus, held_out)  # reads ids only
    return found.agg(F.countDistinct("y")).first()[0] == 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go. Without labels of both kinds nothing can be told, and all stay."""
    if not both_labels(spark, docs, sf_dir, "toxic", 3, 1):
        return docs
    model = toxicity.fit(labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under 0.7 go. Without labels of both kinds nothing can be told, and all stay."""
    if not both_labels(spark, docs, sf_dir, "quality", 4, 2):
        return docs
    model = quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAIN_PER_CLASS, 4, 2))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    Rows of one doc_id stay or go together; rows without a doc_id, and texts without a word, stay.
    """
    gone = near_dup.near_duplicates(docs, shingle_words=5, similarity_percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of ten words, or a whole shorter item, go; with an empty benchmark all stay."""
    return decontaminate.remove_documents(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of 4096 tokens: one row per piece; each row is a document of its own, a null text an empty one."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores decide which rows stay, so SQL cannot express the result; tests/llm/test_pipeline.py holds each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
