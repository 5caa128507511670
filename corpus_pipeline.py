"""Corpus preparation: quality rules, line dedup, near-dedup, PII and packing, stage by stage.

Every stage but the last takes and returns the columns of ``documents``; n_chars follows the
text. Documents that the quality rules reject go; documents of which line dedup leaves no
word go; of each group of near copies (five-word shingles, similarity 0.8) the one with the
smallest doc_id stays; personal data becomes [KIND]; the last stage returns the packed
pieces. SQL can't express the patience alignment, the trained trees or the tokenizer, so
there is no ORACLE_SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linededup, neardup, packing, pii, quality
from millrace.llm.common import WORD, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(rows: DataFrame) -> DataFrame:
    """The columns of documents from (row, text) with the new text."""
    return rows.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return _with_text(out.filter(F.col("gone").isNull() | F.col("text").rlike(WORD)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_groups(docs.select(*COLUMNS), shingle_words=5, percent=80).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(pii.redact(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.tokenised(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
