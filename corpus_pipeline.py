"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage reads what the one before it kept, written as Parquet to the folder that driver and executors share. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from permspark.llm import decontaminate, mixing, quality, simhash, token_files
from permspark.llm.queries import TOKENIZER, table
from permspark.sources.writers import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the trees reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents without an id are compared, too."""
    return simhash.one_of_each(docs, unnamed=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their budgets; a repeated document comes once for each epoch."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document."""
    return token_files.read_documents(token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: No SQL: the quality trees, the fingerprints and the tokenizer can't be written in it. Tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return staged(STAGES[-1][1](spark, docs, sf_dir))
