"""A corpus from raw documents to packed sequences: each stage calls one operator of fluvial.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fluvial.llm import curriculum, jaccard_join, packing, toxicity
from fluvial.llm.common import ensure_checkpoint_dir, short_batches, table
from fluvial.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7, learnt from the labelled ones.

    A null or empty text has the score of no words; repeated rows share one fate; an empty table stays empty.
    """
    short_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram Jaccard similarity the one with the least doc_id; those without words all stay."""
    short_batches(spark)
    return jaccard_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets, in training order; a document taken twice has two rows, one of size 0 none or one."""
    return curriculum.curriculum(docs, position=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' tokens, numbered as sequences; within a length the mix's order stays."""
    short_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), keep_order=True, batch_bytes=1 << 20)  # its workers have done other stages before


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: A trained classifier and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
