"""The corpus pipeline: documents in, packed pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last keep the columns of
documents; rows that a stage rejects, and words or lines that it removes, don't reach the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, fm_dedup, jaccard_join, line_dedup, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.keep_clean(docs, common.read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are near an earlier one; what has no words left goes."""
    return line_dedup.keep_first(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; what has no words left goes."""
    return fm_dedup.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer, linear models or Karmarkar-Karp differencing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what lies between two of them is a Parquet table in the shared folder, which goes when the next is written."""
    docs, last = common.read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
        if last is not None:
            common.discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
