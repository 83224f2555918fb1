"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The first four
return the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basalt.llm import line_dedup, mixing, packing, quality, similar_texts
from basalt.plans.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the repetition rules reject."""
    return quality.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that are at least 0.8 alike to an earlier one, short ones too."""
    return line_dedup.dedup_lines(docs, t=0.8)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates by SimHash: shingles of five words, 0.8 or more alike."""
    return similar_texts.first_of_groups(docs, width=5, t=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target weight asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the mix took into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix_sources), ("best-fit packing", pack)]
#: The drawn mix and the bred packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again, as every stage reads its input more than once."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
