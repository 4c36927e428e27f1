"""Corpus curation: quality, toxicity, near-duplicates, packing.

Each stage takes all that its predecessor kept; all but the last return the columns of documents, whatever
further columns there are. In every stage a null text counts as empty, repeated rows are treated alike, texts
are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import minhash, packing, quality, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those not rejected as bad: an empty text is judged by the model like any other; ties at the threshold stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those not rejected as toxic: a text without words has the model's bias; ties at the threshold go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group, that of the smallest id; repeated rows are copies; texts without words all stay, once an id."""
    return minhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece; an empty text is one piece of the end id; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", near_dedup), ("packing", packed)]

#: The models and signatures of the stages can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written as Parquet in the shared folder and read again."""
    from tessera.llm.shared import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
