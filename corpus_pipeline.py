"""The corpus pipeline: toxic documents go, then exact and near copies, then sources are mixed and texts packed.

Each stage takes the documents that the one before it kept, written as Parquet and
read again, and decides on those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetlake.llm import toxicity
from sheetlake.llm.common import table
from sheetlake.llm.exact_dedup import drop_duplicates
from sheetlake.llm.mixing import mixed_documents
from sheetlake.llm.packing import pack_documents
from sheetlake.llm.queries import tokenizer_files
from sheetlake.llm.simhash_dedup import drop_near_duplicates
from sheetlake.session import checkpointed

ORACLE_SQL = None  # the kernel machine, fingerprints and the packing are beyond SQL; tests hold them against brute force


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut; labels come from the given tables."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one of the smallest id."""
    return drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints within two bits, of three-word shingles: the one of the smallest id."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source schedule takes, once per epoch."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return pack_documents(docs, *tokenizer_files())


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("mix", mixed), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
