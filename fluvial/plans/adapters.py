"""The driver's tables seen as points, rasters, masks, frames and the like; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.operators import grid
from fluvial.sources.checkpoints import cut

#: Cells along each axis of the point grid: quantity by fives and discount by hundredths.
NX = NY = 11
STEP = {"x": 5.0, "y": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a point cloud; the small addend keeps decimal discounts in their cell."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("case_id"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("frame"), F.col("l_orderkey").alias("point"),
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 + 1e-9).alias("y"), F.col("l_extendedprice").alias("z"),
    )


POINTS = """points AS (SELECT l_returnflag AS case_id, l_linestatus AS status, l_linenumber AS frame, l_orderkey AS point,
  l_quantity AS x, l_discount * 100 + 1e-9 AS y, l_extendedprice AS z FROM lineitem),
cells AS (SELECT *, floor(x / 5)::BIGINT AS ix, floor(y)::BIGINT AS iy FROM points)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bin_points(points(spark, sf_dir), STEP)


def raster(spark: SparkSession, sf_dir: str, q: float = 0.2, where: str | None = None) -> DataFrame:
    """One row a cell: z, the exact quantile, rounded so that comparisons don't hang on the last bit.

    The cells, NX * NY at most, are kept, so that a query that looks at them often reads the points once.
    """
    rows = cells(spark, sf_dir)
    found = grid.percentile_raster(rows.where(where) if where else rows, ["ix", "iy"], "z", {"z": q})
    return cut(found.select("ix", "iy", "n", F.round("z", 4).alias("z")))


def raster_sql(name: str = "raster", q: float = 0.2, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT ix, iy, count(*) AS n, round(quantile_cont(z, {q}), 4) AS z FROM cells WHERE {where} GROUP BY ix, iy)"


def level_of(rows: DataFrame, q: float = 0.5) -> DataFrame:
    """One row: a quantile of a raster's heights."""
    return rows.agg(F.round(F.percentile("z", q), 4).alias("level"))


def mask(spark: SparkSession, sf_dir: str, q: float = 0.2, share: float = 0.5) -> DataFrame:
    """Cells below the given quantile of heights."""
    rows = raster(spark, sf_dir, q)
    return rows.crossJoin(F.broadcast(level_of(rows, share))).where("z < level").select("ix", "iy")  # one row


def mask_sql(name: str = "mask", q: float = 0.2, share: float = 0.5) -> str:
    return f"{raster_sql(f'{name}_r', q)}, {name} AS (SELECT ix, iy FROM {name}_r WHERE z < (SELECT round(quantile_cont(z, {share}), 4) FROM {name}_r))"


#: Cells whose state counts as unknown: one diagonal of the grid.
UNKNOWN = "ix + iy = 9"


def unknown_cells(spark: SparkSession) -> DataFrame:
    return spark.range(NX * NY).select((F.col("id") % NX).alias("ix"), F.floor(F.col("id") / NX).alias("iy")).where(UNKNOWN)


GRID_SQL = f"allcells AS (SELECT x AS ix, y AS iy FROM range({NX}) a(x), range({NY}) b(y)), unknown AS (SELECT * FROM allcells WHERE {UNKNOWN})"


def seconds(ts: str = "ts") -> Column:
    """Whole seconds since 2024-01-01, from calendar parts, so the session's time zone plays no part."""
    return F.datediff(F.to_date(ts), F.lit("2024-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


SECONDS = "(date_diff('day', DATE '2024-01-01', ts::DATE) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ordered frames of a user's sequence."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), "event_id", F.col("event_type").alias("cls"), F.col("value").alias("v"), (F.row_number().over(order) - 1).alias("frame"), seconds().alias("sec"))


FRAMES = f"""frames AS (SELECT user_id AS seq, event_id, event_type AS cls, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, {SECONDS} AS sec FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as tracks that last value minutes; purchases of an hour each as annotated events."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'signup'").select(F.col("user_id").alias("seq"), F.col("event_id").alias("id"), seconds().alias("start"), (seconds() + F.floor(F.col("value") * 60)).alias("end"), F.col("value").alias("v"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select(F.col("user_id").alias("seq"), F.col("event_id").alias("id"), seconds().alias("start"), (seconds() + 3600).alias("end"), F.col("value").alias("v"))


TRACKS = f"""tracks AS (SELECT user_id AS seq, event_id AS id, {SECONDS} AS s, {SECONDS} + floor(value * 60)::BIGINT AS e, value AS v FROM events WHERE event_type = 'signup'),
annotations AS (SELECT user_id AS seq, event_id AS id, {SECONDS} AS s, {SECONDS} + 3600 AS e, value AS v FROM events WHERE event_type = 'purchase')"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a score from their length and labels.quality as truth; documents without a label have null."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.round(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), 4).alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id", "left")


SCORED = """scored AS (SELECT d.doc_id, d.source, d.lang, round(least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE), 4) AS score, l.quality AS truth
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


#: Columns of the wide grid: its rows are lineitem's suppliers, so it grows with the table.
WIDE = 100


def wide_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a raster of WIDE columns and one row a supplier: z, the median price of a cell, and n."""
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % WIDE).cast("long").alias("ix"), F.col("l_suppkey").cast("long").alias("iy"), F.col("l_extendedprice").alias("z"))
    return rows.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.round(F.percentile("z", 0.5), 4).alias("z"))


WIDE_RASTER = f"wide AS (SELECT ((l_partkey * 7 + l_linenumber * 13) % {WIDE})::BIGINT AS ix, l_suppkey::BIGINT AS iy, count(*) AS n, round(median(l_extendedprice), 4) AS z FROM lineitem GROUP BY 1, 2)"


def wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an image of WIDE columns, a pixel an event: purchases and sign-ups are water, every other view is unknown."""
    state = F.when(F.col("event_type").isin("purchase", "signup"), "water").when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "unknown").otherwise("dry")
    return table(spark, sf_dir, "events").select((F.col("event_id") % WIDE).alias("u"), F.floor(F.col("event_id") / WIDE).alias("v"), state.alias("state"))


WIDE_PIXELS = f"""px AS (SELECT event_id % {WIDE} AS u, event_id // {WIDE} AS v, CASE WHEN event_type IN ('purchase', 'signup') THEN 'water'
  WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'unknown' ELSE 'dry' END AS state FROM events)"""
