"""Cleaning a corpus in five stages: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows the one before kept, and returns the columns
of ``documents`` (the last one: the pieces and their places). ``run`` writes each stage as a table in the
shared folder and reads it again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerhop.llm import decontamination, language, line_dedup, near_duplicates, packing
from ledgerhop.llm.common import load
from ledgerhop.llm.queries import QUERIES
from ledgerhop.staging import stage

#: No SQL: the stages learn, draw hashes and tokenize; tests hold them against plain versions.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; those without a letter, or torn between two, go."""
    return language.keep_known(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are cut; a document that loses all its words goes."""
    return line_dedup.keep_new(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return near_duplicates.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document that consists mostly of them goes."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", new_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = load(spark, sf_dir, "documents")  # also sets the size of Arrow batches
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
