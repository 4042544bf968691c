"""The corpus pipeline: five stages over `documents`, each written as Parquet and read back as the next one's input.

In all stages a null text counts as empty, other columns are carried along whatever their names, and no rows give no rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from glyphmill.llm.base import read, remove, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts; fitted on the rated documents among them.

    Each row is decided by its own text, so repeated rows share their fate; rows without an id are decided too.  Without ratings of two grades all rows stay.
    """
    return quality.keep_accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id; a repeated row stays once.

    Empty, white and null texts are equal to each other.
    """
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on shingles of five words: the smallest id; a repeated row of it stays once.

    Texts without words link with nothing and stay, as do rows without an id.
    """
    return near_dedup.drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth; each row is decided by its own text, and texts without words stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of at most 2,048 tokens; an empty text is a piece of one token, repeated rows are packed each."""
    return packing.pack(packing.tokenised_pieces(docs))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted, so SQL cannot express the rows; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between two of them the kept documents are a Parquet table in the shared folder.

    Packing cuts the lineage behind its pieces, so the tables in between are removed before the result is returned.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        remove(spark, folder)
