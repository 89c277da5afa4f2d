"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mixing and
token output, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonagraph.llm.decontaminate import decontaminate
from sonagraph.llm import jaccard
from sonagraph.llm.mixing import apply_mix
from sonagraph.llm.quality import quality_filter
from sonagraph.llm.shared import materialize
from sonagraph.llm.tokens import token_report


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects.  Null and empty texts are rejected; repeated rows are
    judged alike; an empty table stays empty; all columns are kept."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id (null last).  Texts that
    share a doc_id are judged apart; of rows that repeat id and text one stays; documents without words
    all stay; an empty table stays empty; all columns are kept."""
    return jaccard.near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item.  Null and empty texts have none and stay, an
    empty benchmark keeps all; repeated rows are judged alike; all columns are kept."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Those without words are not taken; a null source is one
    of its own; rows that repeat id and source share a place; an empty table stays empty; all columns
    are kept, those named like the mix's own as well."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the shards.  A null text is the
    end id alone, null ids come first, repeated rows are written as often as they occur, an empty table
    gives an empty result, other columns are ignored."""
    return token_report(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark),
    ("source_mixing", mixing),
    ("token_output", tokens),
]

#: Tokenizing isn't expressible in SQL; a test holds the pipeline against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
