"""A corpus pipeline of five stages, each over all that its predecessor kept.

quality rules, line dedup, near duplicates (one document of each group stays), personal data, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import bpe, jaccard_join, line_dedup, packing, pii, quality
from stemma.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents from (doc_id, text, rest); n_chars is that of the text as it is now."""
    return rows.select("doc_id", "text", "rest.lang", "rest.source", F.char_length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified thresholds reject go.

    So do null and empty texts, which have no words; rows without an id and repeated rows are judged like any other, a
    missing language is a stratum of its own, an empty table gives no rows.
    """
    return _documents(quality.filter_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first only; no document goes.

    Rows with one id are one document, those without an id one document after all others; a null text comes back empty.
    """
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    Rows without an id stay, as do documents without words; rows that share an id are one document and stay or go together.
    """
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets, overlapping ones the first's; no document goes.  A null text comes back empty."""
    found = pii.find(docs.select(*COLUMNS))
    return _documents(found.withColumn("text", pii.redacted(F.col("text"), F.col("found"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents, as op10 returns them; a null text is its end mark alone, repeated rows are packed each."""
    import public_tokenizers

    pieces = packing.pack(docs.select("doc_id", "text"), bpe.vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]
#: Binomial bounds, boosted trees and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
