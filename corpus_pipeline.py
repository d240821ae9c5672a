"""A corpus from raw documents to packed training sequences, in five stages.

Every stage gets all that its predecessor kept, written as Parquet and read again, and returns the columns of
``documents`` (rows and other columns as they were); the last returns the packing.

1. ``quality``: documents that the quality trees reject go.
2. ``near_copies``: of each class of near copies the one with the smallest id stays.
3. ``benchmark``: documents that hold benchmark items go.
4. ``secrets``: reported secrets are masked in the text.
5. ``packing``: documents are cut and packed into sequences.

Null texts count as empty, null and repeated ids as documents of their own, empty tables go through as empty
ones; extra columns stay until packing. No stage can be told in SQL (boosted trees, tokenizer), so that there
is no SQL twin; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.chosen_path import one_of_each
from millrace.llm.packing import Capacity, pack
from millrace.llm.quality import good_documents
from millrace.llm.queries import table
from millrace.llm.secrets import masked
from millrace.llm.tiling import clean_documents
from millrace.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard index 0.8 or more)."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    placed = pack(docs, Capacity(tokens=1024))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
