"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ponding.llm.common import materialize, table
from ponding.llm.decontaminate import remove_contaminated
from ponding.llm.jaccard_join import one_of_each
from ponding.llm.packing import pack
from ponding.llm.quality_rules import keep_good
from ponding.llm.suffix_dedup import cut_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that start in a document with a smaller doc_id are cut."""
    return cut_documents(docs, width=50)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    return pack(docs, capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the outlier fits, the components and the vocabulary are beyond it. Tests compare the stages and the whole with brute force.
ORACLE_SQL = None
