"""From raw documents to packed training sequences: each stage applies one numbered operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, factors, language_id, packing, paragraphs
from ledgerloom.storage import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def statements_of(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumnRenamed("doc_id", "stmt_id")


def documents_of(statements: DataFrame) -> DataFrame:
    return statements.withColumnRenamed("stmt_id", "doc_id").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter at all) go."""
    return documents_of(language_id.with_known_language(statements_of(docs)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (SimHash groups of op 3, or Jaccard of five-word shingles 0.8 or more, chained) the first by doc_id stays."""
    return documents_of(paragraphs.first_of_each_class(statements_of(docs)))


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id holds are cut out; n_chars follows."""
    cut = documents_of(factors.without_repeated_passages(statements_of(docs)))
    return cut.withColumn("n_chars", F.length("text").cast("bigint"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return documents_of(decontaminate.without_contaminated(statements_of(docs), items))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_statements(
        statements_of(docs), public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("stmt_id", "doc_id")


STAGES = [("language_id", known_language), ("near_duplicates", one_of_each_group), ("suffix_dedup", passages_once),
          ("decontamination", no_benchmark), ("packing", packed)]

#: The trained language network, near duplicates and alignments have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
