"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space that separates words (space and tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared folder; where none is configured a local master gets a local one, and a cluster is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "fluvial-checkpoints"))


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, on: bool = True) -> None:
    """Arrow batches of 2000 rows in place of Spark's 10,000, because whole texts are long rows, or that again; a value set otherwise stays."""
    if spark.conf.get(ARROW_ROWS) == ("10000" if on else "2000"):
        spark.conf.set(ARROW_ROWS, "2000" if on else "10000")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it back: lineage ends here and the rows are computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """cut, and no more partitions than one for so many rows: steps over small tables then need few files, or no shuffle."""
    held = cut(df)
    return held.coalesce(max(1, -(-held.count() // rows)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable keeps the optimizer from copying the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of text; empty for an empty text."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building the filtered array: only the two ends of a split can be empty."""
    inner = F.regexp_replace(text_or_empty(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACES))).cast("long")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)
