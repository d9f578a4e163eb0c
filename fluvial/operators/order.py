"""Numbers in a total order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.sources.checkpoints import cut


def ranked(rows: DataFrame, order: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """rows with their number from 0: range parts are numbered by themselves, then moved by the sizes of those before.

    Rows that order doesn't tell apart get their numbers in any order. The sizes are one row a part.
    """
    dealt = rows.repartitionByRange(*order) if parts is None else rows.repartitionByRange(parts, *order)
    held = cut(dealt.withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.withColumn("_own", own).join(F.broadcast(first), "_part").withColumn(name, (F.col("_own") + F.col("_first")).cast("long")).drop("_part", "_own", "_first")
