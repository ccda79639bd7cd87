"""The corpus pipeline: each stage calls one operator on what the stage before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as a table and read again for the next. Stages
keep all columns of the documents, whatever their names; null texts count as empty, repeated rows are treated
alike unless a stage removes repeats, and an empty table gives an empty table. doc_id is taken as the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldgauge.llm import decontaminate, line_dedup, near_dup, quality_model, sentencepiece_bpe
from fieldgauge.llm.common import durable, table
from fieldgauge.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go; null and empty texts are graded by its thresholds alone."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, within two edits, go; so do documents that have no other text.

    Null and blank texts stay; of repeated rows the lines stay in the first of each doc_id and place.
    """
    return line_dedup.without_repeats(docs, min_chars=line_dedup.ALL_LINES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the least id.

    Texts without words, null ones too, are one class; rows with the least id of their class all stay.
    """
    return near_dup.one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are nothing else go.

    Null and empty texts, and those without a passage, stay as they are; repeated rows are cut alike.
    """
    return decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and digests of them and of the text that they decode to.

    A null or empty text has no ids; repeated rows give repeated rows.
    """
    return sentencepiece_bpe.encode_and_decode(docs, piece_model(), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("SentencePiece encoding and decoding", encode),
]

#: The learned and the tokenizing stages cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
