"""Cleaning a corpus in five stages, from raw documents to token ids.

Each stage takes all documents its predecessor kept. The first four return the columns of ``documents``, the last the
key and the tokens. The benchmark is read from the tables' folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frostline.llm import decontamination, line_dedup, quality_rules, sentencepiece_codec, simhash
from frostline.llm.common import stored, table
from frostline.llm.queries import TOKENIZERS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier line go from the texts."""
    return line_dedup.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Key, token ids and the outcome of the parity and round-trip checks."""
    return sentencepiece_codec.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece", tokens),
]

#: Edit distance joins, the decomposition and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
