"""A corpus pipeline over the training-data operators.

Each stage gets what its predecessor kept, written as Parquet and read again, so a lost executor
never costs more than the stage at hand. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, line_dedup, piece_codec, quality_rules, simhash_dedup
from lakeloom.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    dropped = F.col(found.columns[-1]) > 0
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(dropped, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of what is left."""
    return piece_codec.encode_texts(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: MCD estimates and SimHash are not expressible; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are stored, and what they were made from is deleted."""
    *first, (_, last) = STAGES
    docs, scratch = table(spark, sf_dir, "documents"), Scratch()
    for _, stage in first:
        kept = scratch.alone(lambda now=docs, stage=stage: stage(spark, now, sf_dir))
        scratch.drop(docs)
        docs = kept
    return last(spark, docs, sf_dir)
