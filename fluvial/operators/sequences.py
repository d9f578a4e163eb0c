"""Ordered frames: differences, slopes, curves, crossings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.exprs import safe_corr


def exposure_corrected_differences(pixels: DataFrame, frame_keys: Sequence[str], pixel_keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Each pixel's change from the frame before, after each frame's median is taken off.

    frame_keys name a frame without its order column, pixel_keys a pixel within the sequence. Adds corrected,
    difference, absolute, rise and fall; the first frame has nulls.
    """
    medians = pixels.groupBy(*frame_keys, order).agg(F.median(value).alias("_median"))
    corrected = pixels.join(medians, [*frame_keys, order]).withColumn("corrected", F.col(value) - F.col("_median")).drop("_median")
    change = F.col("corrected") - F.lag("corrected").over(Window.partitionBy(*frame_keys, *pixel_keys).orderBy(order))
    return corrected.withColumn("difference", change).withColumns({"absolute": F.abs("difference"), "rise": F.greatest(F.col("difference"), F.lit(0.0)), "fall": F.greatest(-F.col("difference"), F.lit(0.0))})


def mean_normalised(pixels: DataFrame, keys: Sequence[str], order: str, value: str, low: float, high: float) -> DataFrame:
    """Each frame moved so that its mean is the median of its sequence's frame means, clipped to [low, high]."""
    means = pixels.groupBy(*keys, order).agg(F.avg(value).alias("_mean"))
    middle = means.groupBy(*keys).agg(F.median("_mean").alias("_middle"))
    joined = pixels.join(means, [*keys, order]).join(middle, list(keys))
    return joined.withColumn("normalised", F.least(F.lit(high), F.greatest(F.lit(low), F.col(value) + F.col("_middle") - F.col("_mean")))).drop("_mean", "_middle")


def adjacent_changes(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One row a sequence: steps between frames that follow each other, and their mean, p95 and greatest |change|."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.lag(order).over(w) == F.col(order) - 1, F.abs(F.col(value) - F.lag(value).over(w)))
    return rows.withColumn("_c", step).groupBy(*keys).agg(F.count("*").alias("frames"), F.count("_c").alias("steps"), F.avg("_c").alias("mean_change"), F.percentile("_c", 0.95).alias("p95_change"), F.max("_c").alias("max_change"))


def summary_around(rows: DataFrame, keys: Sequence[str], order: str, value: str, anchor: int) -> DataFrame:
    """One row a sequence: means before, from and after an anchor frame, ends, worst frame, correlation with order."""
    v, o = F.col(value), F.col(order)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(F.when(o < anchor, v)).alias("mean_before"), F.avg(F.when(o >= anchor, v)).alias("mean_after"), F.max(F.when(o == anchor, v)).alias("at_anchor"),
        F.min_by(v, o).alias("first_value"), F.max_by(v, o).alias("last_value"), F.min_by(o, F.struct(v, o)).alias("worst_frame"), safe_corr(o.cast("double"), v).alias("trend_correlation"),
    )


def slope(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Least-squares slope of value over order; 0 for fewer than two rows."""
    return rows.groupBy(*keys).agg(F.coalesce(F.regr_slope(F.col(value).cast("double"), F.col(order).cast("double")), F.lit(0.0)).alias("slope"), F.count("*").alias("n"))


def smoothed(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Moving average of three with the ends repeated; sequences of fewer than three stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value).cast("double")
    whole = Window.partitionBy(*keys)
    mean = (F.coalesce(F.lag(v).over(w), v) + v + F.coalesce(F.lead(v).over(w), v)) / 3
    return rows.withColumn("smoothed", F.when(F.count("*").over(whole) < 3, v).otherwise(mean))


def first_crossing(rows: DataFrame, keys: Sequence[str], order: str, value: str, thresholds: dict[str, float]) -> DataFrame:
    """One row a sequence: the first order at which value reaches each threshold, else null."""
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col(value) >= t, F.col(order))).alias(n) for n, t in thresholds.items()))


def zero_filled(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Sum of value at each order from a sequence's first to its last, 0 where it has no row."""
    sums = rows.groupBy(*keys, order).agg(F.sum(value).alias("total"))
    spine = rows.groupBy(*keys).agg(F.min(order).alias("_a"), F.max(order).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(order))
    return spine.join(sums, [*keys, order], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def contiguous_windows(rows: DataFrame, keys: Sequence[str], order: str, start: int, end: int) -> DataFrame:
    """Frames start..end of each sequence with local numbers, and whether none is missing."""
    inside = rows.where(F.col(order).between(start, end))
    w = Window.partitionBy(*keys)
    return inside.withColumn("local", F.row_number().over(w.orderBy(order)) - 1).withColumn("complete", F.count("*").over(w) == end - start + 1)


def stride(rows: DataFrame, order: Sequence[str], every: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every n-th row after a full sort within each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("_r") % every == 0).drop("_r")


def stable_image(pixels: DataFrame, keys: Sequence[str], frame: str, place: Sequence[str], value: str, skip: int, take: int) -> DataFrame:
    """Median of each place (row, column, channel and the like) over frames skip to skip + take - 1 of its sequence, rounded half to even.

    Values are whole numbers of 0 to 255; a place's histogram of at most 256 counts is what is added up and
    shuffled, so a sequence of any length is summed where it lies. n is how many values the place had, frames
    how many of the frames its sequence had; with fewer than take the median is null.
    """
    keys, place = list(keys), list(place)
    order = Window.partitionBy(*keys).orderBy(frame)
    frames = pixels.select(*keys, frame).distinct().withColumn("_r", F.row_number().over(order) - 1).where((F.col("_r") >= skip) & (F.col("_r") < skip + take))
    whole = frames.groupBy(*keys).agg(F.count("*").alias("frames"))
    histogram = pixels.where(F.col(value).isNotNull()).join(frames.drop("_r"), [*keys, frame]).groupBy(*keys, *place, F.col(value).cast("int").alias("_v")).agg(F.count("*").alias("_n"))
    listed = histogram.groupBy(*keys, *place).agg(F.sort_array(F.collect_list(F.struct("_v", "_n"))).alias("_h"), F.sum("_n").alias("n"))

    def at(rank: Column) -> Column:
        """The value that stands at a rank from 0."""
        start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("int").alias("v"))
        return F.aggregate("_h", start, lambda s, b: F.struct((s["before"] + b["_n"]).alias("before"), F.when(s["v"].isNull() & (rank < s["before"] + b["_n"]), b["_v"]).otherwise(s["v"]).alias("v")), lambda s: s["v"])

    middle = F.rint((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2.0).cast("int")
    return listed.join(whole, keys).select(*keys, *place, "n", "frames", F.when(F.col("frames") == take, middle).alias("median"))
