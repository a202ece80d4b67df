"""The registered queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, importance, language, licenses, lm_score, media, near_dup, packing, quality, toxicity, warc
from .common import fold, labelled_rows, labelled_sample, table

#: Largest number of labelled rows of each class that a classifier learns from.
TRAIN_PER_CLASS = 3000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _held_out(modulus: int, held: int) -> Column:
    return F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 2-word shingles and 80 % similarity; see near_dup.near_duplicates."""
    return near_dup.near_duplicates(_documents(spark, sf_dir), shingle_words=2, similarity_percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from at most TRAIN_PER_CLASS labelled rows of each class outside fold 2 of 4; see quality.score."""
    docs = _documents(spark, sf_dir)
    model = quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", TRAIN_PER_CLASS, 4, 2))
    return quality.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens; see packing.pack_documents."""
    return packing.pack_documents(_documents(spark, sf_dir), default_tokenizer())


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those outside fold 2 of 7; see lm_score.scores."""
    return lm_score.scores(_documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as transport streams and back; stamps has the time stamp and random-access mark of each access unit. See media.media_column and read_media."""
    return media.read_media(media.media_column(_documents(spark, sf_dir)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from documents outside fold 0 of 5; see language.fit and predict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs.drop("lang"), language.fit(docs)).select("doc_id", _held_out(5, 0), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives and back; see warc.archive_round_trip."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from all labelled rows outside fold 1 of 3; see toxicity.fit and score."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1))
    return toxicity.score(docs, model).select("doc_id", _held_out(3, 1), "score", "predicted")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in all documents; see licenses.license_scan."""
    return licenses.license_scan(_documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents; see decontaminate.contamination and report."""
    return decontaminate.report(decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of at least 20 words, drawn towards the benchmark's words; see importance.resample."""
    drawn = importance.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=10, buckets=10_000, longest=1, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own strings, formatted and read back; see chat.format_conversations and read_back."""
    return chat.read_back(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between a byte-level and a sentence-piece vocabulary; see align.align."""
    import public_tokenizers

    return align.align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_quality, op3_packing, op4_lm_scoring, op5_media, op6_language_id, op7_warc, op8_toxicity, op9_licenses, op10_decontamination, op11_importance_resampling, op12_chat_formatting, op13_token_alignment)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op9_licenses": licenses.oracle(),
    "op11_importance_resampling": importance.oracle(),
    "op12_chat_formatting": chat.oracle(),
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT g.b, r.r FROM r JOIN g ON g.a = r.v)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN (SELECT v, min(r) AS c FROM r GROUP BY v) m ON m.v = s.doc_id
""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda k: array_to_string(ws[k:k + least(10, len(ws)) - 1], ' '))) AS said FROM i WHERE len(ws) > 0),
z AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, z.n, unnest(range(1, len(ws) - z.n + 2)) AS k, unnest(list_transform(range(1, len(ws) - z.n + 2), lambda k: array_to_string(ws[k:k + z.n - 1], ' '))) AS said FROM d, z WHERE len(ws) >= z.n),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.said = iw.said AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
}
