"""Water levels from boundaries and shorelines, and which basins below a level hold water."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.operators import grid, regions, stats
from fluvial.sources.checkpoints import cut

METHODS = ("inner_median", "inner_quantile", "bracket_midpoint")


def _rings(labelled: DataFrame, nx: int, ny: int, width: int) -> DataFrame:
    """(component, ix, iy, side): each component's inner ring, and the cells within width outside it."""
    own = labelled.select("ix", "iy", "component")
    inside = regions.neighbours(own, regions.EIGHT, ["component"]).join(own, ["ix", "iy", "component"], "left_semi").groupBy("component", "sx", "sy").count().where("count = 8")
    inner = own.join(inside.select("component", F.col("sx").alias("ix"), F.col("sy").alias("iy")), ["component", "ix", "iy"], "left_anti")
    square = [(i, j) for i in range(-width, width + 1) for j in range(-width, width + 1)]
    grown = regions.neighbours(own, square, ["component"]).where(regions.within(nx, ny)).select("component", "ix", "iy").distinct()
    outer = grown.join(own, ["component", "ix", "iy"], "left_anti")
    return inner.select("component", "ix", "iy", F.lit("inner").alias("side")).unionByName(outer.select("component", "ix", "iy", F.lit("outer").alias("side")))


def boundary_levels(mask: DataFrame, raster: DataFrame, value: str, nx: int, ny: int, method: str = "bracket_midpoint", least_cells: int = 5, least_samples: int = 10, high: float = 0.90, low: float = 0.10, order_tolerance: float = 0.01, widest: float = 0.10, width: int = 1, filter_method: str = "mad") -> DataFrame:
    """One row a component of at least least_cells cells: cells, samples, level and bracket_valid.

    inner_median and inner_quantile take ground heights of the inner ring; bracket_midpoint takes the middle
    between the inner ring's high and the outer ring's low quantile if they are in order and close enough,
    else the inner one. Heights are filtered ring by ring. Too few inner samples give a null level.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    labelled = cut(regions.components(mask, 8))
    sizes = regions.component_sizes(labelled).where(F.col("cells") >= least_cells)
    kept = labelled.join(sizes.select("component"), "component")
    heights = _rings(kept, nx, ny, width).join(raster.select("ix", "iy", F.col(value).alias("_z")), ["ix", "iy"])
    filtered = stats.robust_filter(heights, ["component", "side"], "_z", filter_method)
    inner, outer = F.when(F.col("side") == "inner", F.col("_z")), F.when(F.col("side") == "outer", F.col("_z"))
    found = filtered.groupBy("component").agg(F.count(inner).alias("samples"), F.count(outer).alias("outer_samples"), F.median(inner).alias("_m"), F.percentile(inner, high).alias("_i"), F.percentile(outer, low).alias("_o"))
    gap = F.col("_o") - F.col("_i")
    valid = F.coalesce((F.col("outer_samples") >= least_samples) & (gap >= -order_tolerance) & (F.abs(gap) <= widest), F.lit(False))
    level = {"inner_median": F.col("_m"), "inner_quantile": F.col("_i"), "bracket_midpoint": F.when(valid, (F.col("_i") + F.col("_o")) / 2).otherwise(F.col("_i"))}[method]
    return sizes.join(found, "component", "left").select("component", "cells", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples") >= least_samples, level).alias("level"), (valid if method == "bracket_midpoint" else F.lit(None).cast("boolean")).alias("bracket_valid"))


def overall_level(components: DataFrame, level: str = "level", weight: str = "cells") -> DataFrame:
    """One row: the weighted median of the components' levels."""
    return stats.weighted_median(components, level, weight).select(F.col("weighted_median").alias("level"), "total_weight")


def shoreline_levels(points: DataFrame, keys: Sequence[str], value: str, least_samples: int = 5, statistic: str = "median", filter_method: str = "mad") -> DataFrame:
    """One row a group of shoreline heights: retained samples and level, null below least_samples; median or trimmed."""
    kept = stats.robust_filter(points, keys, value, filter_method)
    if statistic == "trimmed":
        rows = stats.trimmed_median(kept, keys, value).withColumnRenamed("trimmed_median", "_l").join(kept.groupBy(*keys).agg(F.count("*").alias("samples")), list(keys))
    else:
        rows = kept.groupBy(*keys).agg(F.median(value).alias("_l"), F.count("*").alias("samples"))
    return rows.select(*keys, "samples", F.when(F.col("samples") >= least_samples, F.col("_l")).alias("level"))


def supported_basins(basins: DataFrame, support: DataFrame, least_seeds: int = 1, least_pixels: int = 10, least_precision: float = 0.90, ambiguous_precision: float = 0.20) -> DataFrame:
    """Status of each basin (component, cells, seeds) with what a camera sees of it (component, projected, overlap).

    Seeds or enough agreement with the camera's mask select it. Else it is ambiguous if the agreement is
    partial, unobserved (and ambiguous too) if nothing of it is in view, or rejected.
    """
    joined = basins.select("component", "cells", "seeds").join(support, "component", "left").withColumns({"projected": F.coalesce("projected", F.lit(0)), "overlap": F.coalesce("overlap", F.lit(0))})
    rows = joined.withColumn("precision", F.col("overlap") / F.greatest(F.lit(1), F.col("projected")))
    enough = F.col("overlap") >= least_pixels
    status = F.when((F.col("seeds") >= least_seeds) | (enough & (F.col("precision") >= least_precision)), "selected").when(enough & (F.col("precision") >= ambiguous_precision), "ambiguous").when(F.col("projected") == 0, "unobserved").otherwise("rejected")
    return rows.withColumn("status", status)


def waterline_depth(mask: DataFrame, raster: DataFrame, value: str, cell_area: float) -> DataFrame:
    """One row: level (trimmed median of the boundary's ground), boundary samples and spread, covered share, depths, area, volume."""
    heights = regions.inner_ring(mask).join(raster.select("ix", "iy", F.col(value).alias("_z")), ["ix", "iy"]).withColumn("_g", F.lit(1))
    level = stats.trimmed_median(heights, ["_g"], "_z").select(F.col("trimmed_median").alias("level"))
    spread = heights.agg(F.count("_z").alias("boundary_cells"), F.stddev_pop("_z").alias("boundary_std"))
    inside = mask.join(raster.select("ix", "iy", F.col(value).alias("_z")), ["ix", "iy"]).crossJoin(F.broadcast(level))  # one row
    depths = grid.depth_below_level(inside, "_z", F.col("level"), cell_area)
    total = mask.agg(F.count("*").alias("mask_cells"))
    return level.crossJoin(spread).crossJoin(depths).crossJoin(total).withColumn("valid_ratio", F.col("cells") / F.greatest(F.lit(1), F.col("mask_cells")))  # one row each


def wet_share(depth: Column, above: float) -> Column:
    """Share of rows deeper than a bound; null for none."""
    return F.try_divide(F.count_if(depth > above).cast("double"), F.count(depth).cast("double"))
