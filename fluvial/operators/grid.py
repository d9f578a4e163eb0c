"""Points to rasters: filters, exact statistics a cell, gap filling, depth, area and volume.

A raster is a long table of cells (ix, iy and values); a missing cell is a missing row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import cell_index


def finite_points(points: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Rows whose coordinates are all finite."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) != float("inf"))
    return points.where(keep)


def clip_box(points: DataFrame, bounds: dict[str, tuple[float, float]], closed: bool = True) -> DataFrame:
    """Points in a box: both ends belong to it, or with closed=False the lower ones alone."""
    keep = F.lit(True)
    for axis, (low, high) in bounds.items():
        keep = keep & (F.col(axis) >= low) & ((F.col(axis) <= high) if closed else (F.col(axis) < high))
    return points.where(keep)


def snapped_extent(points: DataFrame, step: dict[str, float]) -> DataFrame:
    """One row: the extent of the points, moved outward to whole cells, and cells along each axis."""
    edges = [e for a, g in step.items() for e in ((F.floor(F.min(a) / g) * g).alias(f"{a}_min"), (F.ceil(F.max(a) / g) * g).alias(f"{a}_max"))]
    return points.agg(*edges).select("*", *(F.ceil((F.col(f"{a}_max") - F.col(f"{a}_min")) / g).cast("long").alias(f"n{a}") for a, g in step.items()))


def percentile_raster(points: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], min_points: int = 1) -> DataFrame:
    """Exact linear-interpolated quantiles of value a cell, and n. Sparse cells keep n and have null quantiles."""
    q = list(quantiles.items())
    found = points.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, [p for _, p in q]).alias("_q"))
    enough = F.col("n") >= min_points
    return found.select(*keys, "n", *(F.when(enough, F.get("_q", F.lit(i))).alias(name) for i, (name, _) in enumerate(q)))


def bin_points(points: DataFrame, step: dict[str, float], origin: dict[str, float] | None = None) -> DataFrame:
    """Add i<axis>: the half-open cell along each axis."""
    origin = origin or {}
    return points.withColumns({f"i{a}": cell_index(F.col(a), origin.get(a, 0.0), g) for a, g in step.items()})


def value_summary(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, min, p10, median, p90, max, mean, population deviation, sum of the values that aren't null."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.percentile(v, 0.1).alias("p10"), F.median(v).alias("median"), F.percentile(v, 0.9).alias("p90"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def depth_below_level(raster: DataFrame, ground: str, level, cell_area: float, wet_above: float | None = None) -> DataFrame:
    """One row: cells, area, volume and depth statistics of ground below a water level.

    level is a number or a column. Depth is never negative. wet_above counts only deeper cells; None counts
    all cells. An empty selection gives zeros.
    """
    depth = F.greatest(F.lit(0.0), (level if not isinstance(level, (int, float)) else F.lit(float(level))) - F.col(ground))
    rows = raster.where(F.col(ground).isNotNull()).withColumn("_depth", depth)
    if wet_above is not None:
        rows = rows.where(F.col("_depth") > wet_above)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count("*").alias("cells"),
        (F.count("*") * cell_area).alias("area"),
        zero(F.sum("_depth") * cell_area).alias("volume"),
        zero(F.max("_depth")).alias("max_depth"),
        zero(F.avg("_depth")).alias("mean_depth"),
        zero(F.median("_depth")).alias("median_depth"),
        zero(F.min("_depth")).alias("min_depth"),
    )


def surface_minus_ground(surface: DataFrame, ground: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Cells of both rasters with depth and status: valid in [low, high], negative, below, above; or one-sided."""
    joined = surface.select(*keys, F.col(value).alias("surface")).join(ground.select(*keys, F.col(value).alias("ground")), list(keys), "full")
    depth = F.col("surface") - F.col("ground")
    status = F.when(depth.isNull(), "missing").when(depth < 0, "negative").when(depth < low, "below").when(depth > high, "above").otherwise("valid")
    return joined.withColumn("status", status).withColumn("depth", F.when(F.col("status") == "valid", depth))


def fill_gaps(raster: DataFrame, spine: DataFrame, value: str, radius: int, circular: bool = True) -> DataFrame:
    """Each cell of spine (ix, iy) with its own value or that of the nearest valid cell.

    The nearest lies within a circle of radius cells, or within the square; of equally near ones the first in
    order of iy, ix. Each valid cell meets the (2 radius + 1)^2 cells about it by an equi-join, no more.
    """
    valid = raster.where(F.col(value).isNotNull()).select("ix", "iy", F.col(value).alias("_v"))
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if not circular or dx * dx + dy * dy <= radius * radius))
    spread = valid.withColumn("_o", F.explode(offsets)).select((F.col("ix") + F.col("_o.dx")).alias("ix"), (F.col("iy") + F.col("_o.dy")).alias("iy"), "_v", (F.col("_o.dx") * F.col("_o.dx") + F.col("_o.dy") * F.col("_o.dy")).alias("_d2"), F.col("iy").alias("_y"), F.col("ix").alias("_x"))
    nearest = spread.groupBy("ix", "iy").agg(F.min_by("_v", F.struct("_d2", "_y", "_x")).alias(value), F.min("_d2").alias("distance2"))
    return spine.select("ix", "iy").distinct().join(nearest, ["ix", "iy"], "left")


def compare_rasters(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: cells in both, in either, in one alone, and mean and median difference a - b."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    d = F.col("_a") - F.col("_b")
    return joined.agg(F.count_if(ina & inb).alias("overlap"), F.count_if(ina | inb).alias("in_either"), F.count_if(ina & ~inb).alias("only_a"), F.count_if(inb & ~ina).alias("only_b"), F.avg(d).alias("mean_difference"), F.median(d).alias("median_difference"))
