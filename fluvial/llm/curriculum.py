"""Mixing sources to target weights: a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.llm.common import cut, word_count

#: Weights of sources in order of code points, repeating, and what they share of all sizes.
CYCLE, SHARE = (5, 2, 1), 1.5


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: float = 2.0) -> DataFrame:
    """One row per source of (source, source_size): its weight and target.

    Sources take weights of the cycle in order of code points, null last, and share `share` of all sizes by
    weight; a target stops at `most` times its source's size and the excess is shared again by weight until
    none is above. That is filling to a level: in order of limit over weight, a source is full if its limit
    is at most its share of what fuller ones left. The windows run over one row per source.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(cycle))) + 1)
    every = Window.partitionBy()
    order = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("_limit", F.col("source_size") * F.lit(most))
        .withColumn("_ratio", F.col("_limit") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_ratio") <= F.col("_left") / F.sum("weight").over(onward))
    )
    level = F.try_divide(F.max("_budget").over(every) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(every), F.lit(0.0)), F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every))
    return filled.withColumn("_level", level).select("source", "source_size", "weight", F.round(F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("weight") * F.col("_level")), 4).alias("target"))


def cumulative_demand(t: Column, tilt: Column) -> Column:
    """Share of its target that a source gives until time t (0 to 1): the integral of 1 + tilt * (1 - 2 s)."""
    return t + tilt * t * (F.lit(1.0) - t)


def training_time(q: Column, tilt: Column) -> Column:
    """Time at which a share q of a source's target has been given: cumulative_demand inverted.

    Of the two roots of tilt * t**2 - (1 + tilt) * t + q = 0 it is the one in [0, 1], written so that a tilt
    of 0 needs no case of its own.
    """
    b = F.lit(1.0) + tilt
    root = F.try_divide(F.lit(2.0) * q, b + F.sqrt(F.greatest(F.lit(0.0), b * b - F.lit(4.0) * tilt * q)))  # 0 by 0 at the start of a tilt of -1
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(root, F.lit(0.0))))


def assign(docs: DataFrame, tilt: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and its first position.

    A source with target T of size S gives every document floor(T / S) times, then the documents that come
    first in order of the id's MD5 once more while half of a document still fits into what is left; so taken
    words miss the target by half of one document at most, and no document exceeds twice its size. The
    source's words so far give the share of its target at which a document stands, and its schedule,
    1 + tilt * (1 - 2 t) over time t, gives the position (null if nothing is taken). tilt is a column over
    weight between -1 and 1; as given, light sources come early and heavy ones late.

    A source may hold most rows: sums run in blocks by the first three digits of the MD5 (4096 for a source),
    whose totals give where each block begins. Only ids and sizes are shuffled. Null texts have size 0;
    repeated rows count each for itself, and tie by size alone; an empty table gives no rows; other columns
    are ignored.
    """
    held = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
        .withColumn("_md5", _key(F.col("doc_id")))
        .withColumn("_block", F.substring("_md5", 1, 3))
    )
    blocks = held.groupBy("source", "_block").agg(F.sum("size").alias("_size"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("_size").alias("source_size")))
    tilt = F.lit(0.8) * (F.lit(2.0) / F.col("weight") - F.lit(1.0)) if tilt is None else tilt
    starts = (
        blocks.withColumn("_first", F.sum("_size").over(Window.partitionBy("source").orderBy("_block")) - F.col("_size"))
        .withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .select("_source", F.col("_block").alias("_in"), "_first", "source_size", "target", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tilt)).alias("_tilt"))
    )
    inside = Window.partitionBy("source", "_block").orderBy("_md5", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        held.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_in")))
        .withColumn("_before", F.col("_first") + F.col("_within"))
        .withColumn("_passes", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)))
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("_times", F.col("_passes") + (F.col("_before") + F.col("size") * 0.5 < F.col("_rest")).cast("long"))
        .withColumn("position", F.when(F.col("_times") > 0, training_time(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("_before") + F.col("size") * 0.5, F.col("target")), F.lit(0.0))), F.col("_tilt"))))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("_times") * F.col("size")).alias("taken"), F.col("_times").alias("times"), "position", "_before", "_tilt", "_md5")
    )


def in_order(docs: DataFrame, tilt: Column | None = None, blocks: int = 4096) -> DataFrame:
    """assign, range-partitioned and sorted by position, with rank: the document's place (from 1) among all that the mix takes.

    Positions come from the source's schedule, integrated and inverted; ties go by source, MD5 of the id, id and
    size. Ranks are counted in blocks of equal ranges of position, of which there are at most `blocks` and one, so no
    window spans the table. Documents that aren't taken have neither position nor rank and come last.
    """
    held = cut(assign(docs, tilt).withColumn("_block", F.when(F.col("position").isNotNull(), F.floor(F.col("position") * blocks)).otherwise(F.lit(blocks + 1))))
    counts = held.groupBy("_block").agg(F.count("*").alias("_n"))
    first = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_first"))
    within = Window.partitionBy("_block").orderBy("position", F.asc_nulls_last("source"), "_md5", F.asc_nulls_last("doc_id"), "size")
    taken = held.where("position IS NOT NULL").withColumn("_rank", F.row_number().over(within))
    ranked = taken.join(F.broadcast(first), "_block").withColumn("rank", (F.col("_first") + F.col("_rank")).cast("long")).drop("_rank", "_first")  # blocks + 1 rows
    left = held.where("position IS NULL").withColumn("rank", F.lit(None).cast("long"))
    # those left out are spread over the last ranges
    key = F.coalesce(F.col("position"), F.lit(2.0) + F.crc32("_md5") / F.lit(2.0**32))
    return ranked.unionByName(left).withColumn("_order", key).repartitionByRange("_order").sortWithinPartitions("_order", "rank").drop("_order", "_block", "_md5")


def curriculum(docs: DataFrame, tilt: Column | None = None, position: str | None = "position") -> DataFrame:
    """The mix in training order: docs' columns and the position, a row for each time a document is taken.

    The n-th time stands one pass of its source later. Rows are range-partitioned and sorted by position, so
    writing them keeps the order; position names the column, which takes the place of one of docs of that name,
    None leaves it out. Documents of one doc_id are
    told apart by their number of words; among those that also agree in it each gets the positions of the
    first. Null doc_ids meet each other.
    """
    plan = assign(docs, tilt).where("times > 0")
    share = lambda n: F.least(F.lit(1.0), F.coalesce(F.try_divide(n * F.col("source_size") + F.col("_before") + F.col("size") * 0.5, F.col("target")), F.lit(0.0)))
    plan = plan.withColumn("_positions", F.transform(F.sequence(F.lit(0), (F.col("times") - 1).cast("int")), lambda n: training_time(share(n), F.col("_tilt"))))
    # one row per id and size, so the join can't multiply repeated rows
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.min("_positions").alias("_positions"))
    names = [c for c in docs.columns if c != position]
    packed = docs.select(F.struct(*names).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), word_count(F.col("text")).alias("_words"))
    mixed = packed.join(plan, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size"))).select("_doc", F.explode("_positions").alias("_position"))
    ordered = mixed.repartitionByRange(F.col("_position")).sortWithinPartitions("_position")
    return ordered.select("_doc.*", *([F.col("_position").alias(position)] if position else []))


def oracle() -> str:
    """DuckDB SQL for the rows of op5."""
    return r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS ratio,
    (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM w
), g AS (
  SELECT *, ratio <= (budget - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM f WINDOW o AS (ORDER BY ratio, source NULLS LAST)
), l AS (
  SELECT (max(budget) - coalesce(sum(lim) FILTER (is_full), 0.0)) / sum(weight) FILTER (NOT is_full) AS lev FROM g
), t AS (SELECT source, source_size, round(CASE WHEN is_full THEN lim ELSE weight * lev END, 4) AS target, weight FROM g, l), b AS (
  SELECT d.*, t.source_size, t.target, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE * (2.0::DOUBLE / t.weight - 1.0::DOUBLE))) AS tilt, coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, passes + CASE WHEN before + size * 0.5 < target - passes * source_size THEN 1 ELSE 0 END AS times,
    least(1.0::DOUBLE, CASE WHEN target > 0 THEN (before + size * 0.5::DOUBLE) / target ELSE 0.0 END) AS q, 1.0::DOUBLE + tilt AS e FROM b
), r AS (SELECT *, e + sqrt(greatest(0.0::DOUBLE, e * e - 4.0::DOUBLE * tilt * q)) AS below FROM c), p AS (
  SELECT *, CASE WHEN times > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN below = 0 THEN 0.0 ELSE 2.0::DOUBLE * q / below END)) END AS place FROM r
)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, round(place, 9) AS position,
  CASE WHEN place IS NOT NULL THEN row_number() OVER (ORDER BY place NULLS LAST, source NULLS LAST, k, doc_id NULLS LAST, size) END::BIGINT AS rank
FROM p"""
