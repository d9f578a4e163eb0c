"""Basins and shorelines judged by a camera's mask of three values: water, unknown, and dry for the rest of the image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import ratio_floor_one
from fluvial.operators import regions
from fluvial.operators.joins import nearest_distance
from fluvial.operators.order import ranked
from fluvial.sources.checkpoints import cut


def checked(pixels: DataFrame) -> DataFrame:
    """pixels (u, v, state) as one row a pixel; one that is both water and unknown, or of another state, is an error when it is read."""
    states = F.collect_set("state")
    bad = F.array_contains(states, "water") & F.array_contains(states, "unknown")
    known = F.forall(states, lambda s: s.isin("water", "unknown", "dry"))
    one = F.when(F.array_contains(states, "water"), "water").when(F.array_contains(states, "unknown"), "unknown").otherwise("dry")
    return pixels.groupBy("u", "v").agg(F.when(bad | ~known, F.raise_error(F.lit("water and unknown pixels must not overlap"))).otherwise(one).alias("state"))


def basin_support(labelled: DataFrame, seeds: DataFrame, footprints: DataFrame, pixels: DataFrame) -> DataFrame:
    """One row a component: cells, seeds, projected, known, water, dry and unknown pixels, and precision over known ones (null without).

    labelled: ix, iy, component. footprints: the pixels (u, v) that a cell (ix, iy) covers in the image, any
    number a cell; a pixel that several cells of a component cover counts once. pixels: u, v, state of the
    whole image; a footprint outside it isn't projected. Everything meets by equal keys; groups are a
    component's pixels, counted after equal ones have met.
    """
    seeded = labelled.join(seeds.select("ix", "iy").distinct().withColumn("_seed", F.lit(1)), ["ix", "iy"], "left")
    sizes = seeded.groupBy("component").agg(F.count("*").alias("cells"), F.count("_seed").alias("seeds"))
    drawn = labelled.join(footprints, ["ix", "iy"]).select("component", "u", "v").distinct()
    seen = drawn.join(checked(pixels), ["u", "v"]).groupBy("component").agg(F.count("*").alias("projected"), *(F.count_if(F.col("state") == s).alias(s) for s in ("water", "unknown", "dry")))
    rows = sizes.join(seen, "component", "left").fillna(0, ["projected", "water", "unknown", "dry"])
    known = F.col("projected") - F.col("unknown")
    return rows.withColumn("known", known).withColumn("precision", F.when(known > 0, F.col("water") / known))


def judged_basins(support: DataFrame, least_seeds: int = 1, least_pixels: int = 10, least_precision: float = 0.90, ambiguous_precision: float = 0.20, unknown_aware: bool = True) -> DataFrame:
    """support with status and ambiguous.

    selected: seeds, or enough water pixels at enough precision. Else unobserved (no pixel in the image),
    unknown_only (none of a known state) or ambiguous (water pixels at a lesser precision), which all leave
    the scene ambiguous; else rejected. Without unknown_aware precision is over all projected pixels (at
    least one), and partial agreement is asked before unobserved.
    """
    c = F.col
    precision = c("precision") if unknown_aware else ratio_floor_one(c("water"), c("projected"))
    rows = support.withColumn("precision", precision)
    enough = c("water") >= least_pixels
    chosen = (c("seeds") >= least_seeds) | (enough & F.coalesce(c("precision") >= least_precision, F.lit(False)))
    partial = enough & F.coalesce(c("precision") >= ambiguous_precision, F.lit(False))
    status = F.when(chosen, "selected").when(c("projected") == 0, "unobserved")
    status = (status.when(c("known") == 0, "unknown_only") if unknown_aware else status).when(partial, "ambiguous").otherwise("rejected")
    return rows.withColumn("status", status).withColumn("ambiguous", c("status").isin("unobserved", "unknown_only", "ambiguous"))


def reconstructed(raster: DataFrame, value: str, level, seeds: DataFrame, footprints: DataFrame, pixels: DataFrame, connectivity: int = 8, **thresholds) -> tuple[DataFrame, DataFrame]:
    """The water's cells (ix, iy, component) and the judged basins, for cells of raster below level (a column or number).

    A seed counts only where it lies below the level. Null heights are never water.
    """
    low = cut(raster.where(F.col(value) < level).select("ix", "iy"))
    labelled = cut(regions.components(low, connectivity))
    judged = cut(judged_basins(basin_support(labelled, seeds, footprints, pixels), **thresholds))
    return labelled.join(judged.where("status = 'selected'").select("component"), "component").select("ix", "iy", "component"), judged


def scene(judged: DataFrame) -> DataFrame:
    """One row over all basins: how many of each status, cells of candidates and of water, seeds, and whether the scene is decided."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return judged.agg(
        F.count("*").alias("candidates"), *(n(s) for s in ("selected", "ambiguous", "unobserved", "unknown_only", "rejected")),
        F.coalesce(F.sum("cells"), F.lit(0)).alias("candidate_cells"), F.coalesce(F.sum(F.when(F.col("status") == "selected", F.col("cells"))), F.lit(0)).alias("water_cells"),
        F.coalesce(F.sum("seeds"), F.lit(0)).alias("valid_seeds"), F.coalesce(F.max("ambiguous"), F.lit(False)).alias("ambiguous_scene"),
        F.coalesce((F.sum("seeds") > 0) & (F.count_if(F.col("status") == "selected") > 0), F.lit(False)).alias("seed_valid"),
    )


def trusted_shoreline(water: DataFrame, unknown: DataFrame, nx: int, ny: int, least_pixels: int = 10, stride: int = 2, connectivity: int = 8, edge_band: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sampled shoreline points (component, ix, iy, u, v) of water's components, and one row of counts.

    Points are the steps from water to known dry pixels, half a pixel from the water's centre; components
    below least_pixels give none. Of the points in order of row, column, and neighbour (above, below, left,
    right) every stride-th is taken. Counts are over all components: interfaces by kind, their trusted share,
    components kept, points and samples, and the share of water within edge_band pixels of the image's edge.
    """
    labelled = cut(regions.components(water, connectivity))
    kept = labelled.join(regions.component_sizes(labelled).where(F.col("cells") >= least_pixels), "component")
    steps = cut(regions.trusted_interface(water, unknown, nx, ny))
    turn = F.when(F.col("ny") < F.col("iy"), 0).when(F.col("ny") > F.col("iy"), 1).when(F.col("nx") < F.col("ix"), 2).otherwise(3)
    points = steps.where("kind = 'trusted'").join(kept.select("ix", "iy", "component"), ["ix", "iy"]).withColumn("_turn", turn)
    numbered = ranked(points, ["iy", "ix", "_turn"], "_rank")
    half = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    sampled = numbered.where(F.col("_rank") % stride == 0).select("component", "ix", "iy", half("ix", "nx").alias("u"), half("iy", "ny").alias("v"))
    near = (F.col("ix") < edge_band) | (F.col("ix") >= nx - edge_band) | (F.col("iy") < edge_band) | (F.col("iy") >= ny - edge_band)
    kinds = steps.agg(F.count("*").alias("interfaces"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("trusted", "unknown", "edge")))
    parts = [
        kinds.withColumn("trusted_share", ratio_floor_one(F.col("trusted"), F.col("interfaces"))),
        labelled.agg(F.count_distinct("component").alias("components"), ratio_floor_one(F.count_if(near), F.count("*")).alias("edge_touch")),
        kept.agg(F.count_distinct("component").alias("kept")), points.agg(F.count("*").alias("points")),
    ]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.crossJoin(p)  # one row each
    return sampled, counts.withColumn("samples", F.ceil(F.col("points") / stride))


def reprojection(observed: DataFrame, unknown: DataFrame, predicted: DataFrame, nx: int, ny: int) -> DataFrame:
    """One row: how a predicted mask agrees with the observed one where the camera knows, and how far their trusted boundaries lie apart.

    All masks are ix, iy. Boundaries are water pixels beside known dry ones; distances of both sides are taken
    together, null without both.
    """
    known = predicted.select("ix", "iy").distinct().join(unknown, ["ix", "iy"], "left_anti")
    overlap = regions.overlap_metrics(known, observed).select("iou", "precision", "recall", F.col("predicted").alias("predicted_pixels"), F.col("truth").alias("observed_pixels"))
    edge = lambda m: cut(regions.trusted_interface(m, unknown, nx, ny).where("kind = 'trusted'").select("ix", "iy").distinct())
    a, b = edge(observed.select("ix", "iy").distinct()), edge(known)
    both = nearest_distance(a, b).unionByName(nearest_distance(b, a)).where("distance IS NOT NULL")
    apart = both.agg(F.avg("distance").alias("boundary_mean"), F.percentile("distance", 0.95).alias("boundary_p95"))
    sizes = [m.agg(F.count("*").alias(n)) for n, m in (("unknown_pixels", unknown.select("ix", "iy").distinct()), ("observed_boundary", a), ("predicted_boundary", b))]
    out = overlap.crossJoin(apart)
    for s in sizes:
        out = out.crossJoin(s)  # one row each
    return out


def boundary_diagnostics(observed: DataFrame, unknown: DataFrame, predicted: DataFrame, nx: int, ny: int, near: float = 3.0, far: float = 10.0) -> DataFrame:
    """One row: how far trusted boundaries of two masks (ix, iy) lie apart, and where they lie far apart.

    p50, p95 and mean of both sides' distances with the shares above near and far (null without both sides);
    tail_pixels, boundary pixels above far, and tail_box, their bounding box's share of the image; how much of
    the observed mask's inner ring lies in or beside unknown pixels; whether the prediction touches the
    image's border.
    """
    seen = predicted.select("ix", "iy").distinct()
    known = cut(seen.join(unknown, ["ix", "iy"], "left_anti"))
    edge = lambda m: cut(regions.trusted_interface(m, unknown, nx, ny).where("kind = 'trusted'").select("ix", "iy").distinct())
    a, b = edge(observed.select("ix", "iy").distinct()), edge(known)
    both = cut(nearest_distance(a, b).unionByName(nearest_distance(b, a)).where("distance IS NOT NULL"))
    d = F.col("distance")
    apart = both.agg(F.percentile("distance", 0.5).alias("p50"), F.percentile("distance", 0.95).alias("p95"), F.avg("distance").alias("mean"), F.avg((d > near).cast("double")).alias("above_near"), F.avg((d > far).cast("double")).alias("above_far"))
    span = lambda c: F.max(c) - F.min(c) + 1
    tail = both.where(d > far).agg(F.count_distinct("ix", "iy").alias("tail_pixels"), F.coalesce(span("ix") * span("iy") / F.lit(float(nx * ny)), F.lit(0.0)).alias("tail_box"))
    ring = cut(regions.inner_ring(observed.select("ix", "iy").distinct()))
    beside = regions.dilate(unknown.select("ix", "iy").distinct(), nx, ny)
    touch = ring.join(beside.withColumn("_u", F.lit(1)), ["ix", "iy"], "left").agg(F.count("_u").alias("unknown_touching"), ratio_floor_one(F.count("_u"), F.count("*")).alias("unknown_touching_share"))
    border = F.col("ix").isin(0, nx - 1) | F.col("iy").isin(0, ny - 1)
    return apart.crossJoin(tail).crossJoin(touch).crossJoin(seen.agg(F.coalesce(F.max(border), F.lit(False)).alias("touches_border")))  # one row each


def component_metrics(mask: DataFrame, small: int = 100, connectivity: int = 8) -> DataFrame:
    """One row: components of a mask, cells of the largest, the others, and those among the others of at most `small` cells."""
    sizes = regions.component_sizes(regions.components(mask, connectivity))
    # of equally large ones any is the largest: the rest are counted, not named
    n, top = F.count("*"), F.coalesce(F.max("cells"), F.lit(0))
    few = F.count_if(F.col("cells") <= small) - F.when(top <= small, F.least(n, F.lit(1))).otherwise(F.lit(0))
    return sizes.agg(n.alias("components"), top.alias("largest"), F.greatest(n - 1, F.lit(0)).alias("others"), few.alias("small_others"))
