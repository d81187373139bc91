"""From documents to tokens in five stages, each an operator of lexispark.llm; see STAGES.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, line_dedup, mixing, near_dedup, repetition
from lexispark.llm.common import checkpointed, fresh, own_columns, quoted

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go; null and empty texts are among them."""
    return repetition.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts; no row goes, and n_chars follows the text.

    Null texts stay null. Rows that repeat an id with another text, and rows with a null id, are documents of their own; a null id comes last.
    """
    lines, removed = fresh(docs, "_lines", "_removed_lines")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=removed)
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.select(*[n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays, that with the least id (null last). Texts without words have no group.

    Rows that repeat an id go or stay by their own text; of equal rows one stays.
    """
    return near_dedup.deduplicated(docs, shingle_words=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, and one with the first words for a part; documents of which it takes nothing go.

    Null ids and null sources take part like others; rows that repeat an id are taken one by one.
    """
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text with their byte offsets, n_tokens, and whether they decode to the text. Null counts as the empty text; columns of these names are replaced."""
    added = ("n_tokens", "bpe_ids", "bpe_offsets", "round_trip")
    own = docs.select(*own_columns(docs, added))
    tokens = bpe.encode(own, VOCABULARY, verified="round_trip")
    return tokens.select(*own_columns(own), F.size("bpe_ids").cast("long").alias("n_tokens"), "bpe_ids", "bpe_offsets", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("source mixing", source_mixing),
    ("byte bpe", byte_bpe),
]

#: Minimum hashing, the mix's shuffle and byte pair merges can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage reads what the one before it wrote, as stages read their documents several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
