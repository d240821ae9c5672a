"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.sql import NEAR_COPIES, SECRETS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``sql`` gives the same rows in DuckDB."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    from millrace.llm.packing import Capacity, pack

    placed = pack(table(spark, folder, "documents"), Capacity(tokens=1024))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written to seekable files and read back."""
    from millrace.llm.seekable import token_files_digest

    return token_files_digest(spark, table(spark, folder, "documents"))


@query("op2_credential_linking", SECRETS)
def credential_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    from millrace.llm.secrets import secret_digest

    return secret_digest(table(spark, folder, "documents"))


@query("op6_quality_trees")
def quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    from millrace.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_string_tiling")
def string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, whole or in parts in any order."""
    from millrace.llm.tiling import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_cross_polytope")
def cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    from pyspark.sql import functions as F

    from millrace.llm.neighbours import neighbours

    return neighbours(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


@query(
    "op3_merkle_audit",
    "SELECT page_id, 'changed' AS status, CAST(count(*) AS BIGINT) AS records FROM pages WHERE page_id % 97 = 13 GROUP BY page_id",
)
def merkle_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC files, a replica with a turned bit in some records, and the audit that finds them."""
    from pyspark.sql import functions as F

    from millrace.llm.warc import audit, replicate, write_warc

    index = write_warc(table(spark, folder, "pages"))
    copies = replicate(index, damage=F.col("page_id") % 97 == 13)
    return audit(index, copies).groupBy("page_id", "status").agg(F.count(F.lit(1)).alias("records"))


@query("op4_chosen_path_join", NEAR_COPIES)
def chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among all documents: five-word shingles, a Jaccard index of 0.8 or more."""
    from millrace.llm.chosen_path import similar_classes

    return similar_classes(table(spark, folder, "documents")).drop("row", "class_no")


@query("op8_chain_language")
def chain_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    from millrace.llm.language import predicted_languages

    return predicted_languages(table(spark, folder, "documents"))


@query("op5_ngram_trie")
def ngram_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document by a model of the documents that are not held out."""
    from pyspark.sql import functions as F

    from millrace.llm.ngram_model import is_held_out, scores

    return scores(table(spark, folder, "documents"), is_held_out(F.col("doc_id")))


@query("op11_dialogue_repair")
def dialogue_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    from millrace.llm.dialogue import damaged_and_repaired

    return damaged_and_repaired(table(spark, folder, "conversations"))


@query("op13_suffix_automata")
def suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without passages of 13 or more words that an earlier one holds."""
    from millrace.llm.repeats import repeats_digest

    return repeats_digest(table(spark, folder, "documents"))


@query("op12_interval_coalescing")
def interval_coalescing(spark: SparkSession, folder: str) -> DataFrame:
    """Two tokenizers aligned over every document."""
    from millrace.llm.alignment import alignment_digest

    return alignment_digest(table(spark, folder, "documents"))
