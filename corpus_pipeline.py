"""A corpus from raw documents: quality rules, near-dedup, redaction, mixing and packing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. No step of it can be written in SQL that gives the
same rows (fingerprints, boosted trees, dependent rounding, subset sums), so ORACLE_SQL is None; the tests hold each
stage against a brute-force version.

Cases. Each stage has those of its operator (nulls in any column, empty and very long texts, ties, repeated rows, empty
tables, columns with any names), which its docstring states: a null text is rejected by the first stage, so no later one
meets it; rows that repeat an id are rows of their own, and near copies whatever their ids; other columns go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import minhash, mixing, packing, pii, quality
from plumbline.llm.common import PATHS, importable, new_path, read, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose lines that stand in too many documents of their host."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more over 5-word shingles) stays.

    SimHash with pigeonring chains proposes, MinHash bands add what it misses, the shingle sets decide.
    """
    importable(spark)
    return minhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by tags."""
    return pii.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    importable(spark)
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("pii", redact), ("mix_sources", mix_sources), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = new_path(spark, f"pipeline-{name}"), len(PATHS)
        stage(spark, docs, sf_dir).write.parquet(path)
        # what the stage wrote for itself, and what it read, is of no use once its rows are there
        remove(spark, *PATHS[mark:], *([before] if before else []))
        docs, before = spark.read.parquet(path), path
    return docs
