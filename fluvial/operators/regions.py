"""Masks as sets of cells (ix, iy): rings, growth, components, holes, repair, overlap and distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import ratio_floor_one, ratio_or_null, ratio_or_zero
from fluvial.operators.joins import nearest_distance
from fluvial.operators.order import ranked
from fluvial.sources.checkpoints import cut

#: Neighbours of a cell.
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def neighbours(cells: DataFrame, steps: Sequence[tuple[int, int]], carry: Sequence[str] = ()) -> DataFrame:
    """Cells one step away, with the cell that they came from as sx, sy."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    return cells.withColumn("_s", F.explode(around)).select((F.col("ix") + F.col("_s.i")).alias("ix"), (F.col("iy") + F.col("_s.j")).alias("iy"), F.col("ix").alias("sx"), F.col("iy").alias("sy"), *carry)


def within(nx: int, ny: int) -> Column:
    return F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1)


def grid(spark, nx: int, ny: int) -> DataFrame:
    """All cells of an nx by ny grid."""
    return spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))


def inner_ring(mask: DataFrame) -> DataFrame:
    """Cells of the mask with one of eight neighbours outside; beyond the grid is outside."""
    full = neighbours(mask, EIGHT).join(mask, ["ix", "iy"], "left_semi").groupBy("sx", "sy").count().where("count = 8").select(F.col("sx").alias("ix"), F.col("sy").alias("iy"))
    return mask.join(full, ["ix", "iy"], "left_anti")


def dilate(mask: DataFrame, nx: int, ny: int, times: int = 1) -> DataFrame:
    """Eight-neighbour growth, clipped to the grid: times steps are one square of that radius."""
    square = [(i, j) for i in range(-times, times + 1) for j in range(-times, times + 1)]
    return neighbours(mask, square).where(within(nx, ny)).select("ix", "iy").distinct()


def erode(mask: DataFrame, nx: int, ny: int, times: int = 1) -> DataFrame:
    """Cells whose square of that radius lies in the mask; beyond the grid counts as inside."""
    square = [(i, j) for i in range(-times, times + 1) for j in range(-times, times + 1)]
    out = neighbours(mask, square).where(within(nx, ny)).join(mask, ["ix", "iy"], "left_anti").select(F.col("sx").alias("ix"), F.col("sy").alias("iy")).distinct()
    return mask.join(out, ["ix", "iy"], "left_anti")


def outer_ring(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cells beside the mask, in the grid."""
    return dilate(mask, nx, ny).join(mask, ["ix", "iy"], "left_anti")


#: Cells along the sides of the blocks that components are first found in.
BLOCK = 256


def _local_roots(ix: np.ndarray, iy: np.ndarray, steps: Sequence[tuple[int, int]]) -> np.ndarray:
    """For different cells in order of iy, ix the index of the first cell of each one's component."""
    wide = int(ix.max() - ix.min()) + 3
    place = (iy - iy.min() + 1) * wide + (ix - ix.min() + 1)
    pairs = []
    for i, j in steps:
        if (j, i) < (0, 0):  # each pair of neighbours from its later cell alone
            at = np.minimum(np.searchsorted(place, place + j * wide + i), len(place) - 1)
            met = np.flatnonzero(place[at] == place + j * wide + i)
            pairs.append(np.stack([at[met], met]))
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(len(place))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def components(mask: DataFrame, connectivity: int = 8, block: int = BLOCK, most_rounds: int = 100) -> DataFrame:
    """mask with component (1 for the one that comes first in order of iy, ix) for four or eight neighbours.

    Components are found within blocks of cells first, so that only pairs of their first cells meet across
    blocks' borders; each round gives such a cell the least one among its own, its partners', and that of the
    cell that it names. So rounds grow with the logarithm of the blocks that a component spans, and are
    checkpointed. A task holds one block.
    """
    steps = FOUR if connectivity == 4 else EIGHT

    def local(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates().sort_values(["iy", "ix"])
        x, y = group["ix"].to_numpy(), group["iy"].to_numpy()
        root = _local_roots(x, y, steps)
        return pd.DataFrame({"ix": x, "iy": y, "ry": y[root], "rx": x[root]})

    whole = mask.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).where("ix IS NOT NULL AND iy IS NOT NULL")
    blocks = whole.groupBy(F.floor(F.col("ix") / block).alias("bx"), F.floor(F.col("iy") / block).alias("by"))
    cells = cut(blocks.applyInPandas(local, "ix long, iy long, ry long, rx long").withColumn("_c", F.struct("ry", "rx")).select("ix", "iy", "_c"))
    last = F.pmod(F.col("ix"), F.lit(block)).isin(0, block - 1) | F.pmod(F.col("iy"), F.lit(block)).isin(0, block - 1)
    border = cells.where(last)
    met = neighbours(border, steps, ["_c"]).withColumnRenamed("_c", "_o").join(border, ["ix", "iy"]).where("_c <> _o").select("_c", "_o").distinct()
    edges, roots = cut(met), None
    if not edges.isEmpty():
        labels = cut(edges.select(F.col("_c").alias("_v"), F.col("_c").alias("_m")).distinct())
        for _ in range(most_rounds):
            told = edges.join(labels, edges["_o"] == labels["_v"]).select(edges["_c"].alias("_v"), "_m")
            least = told.unionByName(labels).groupBy("_v").agg(F.min("_m").alias("_m"))
            root = least.select(F.col("_v").alias("_m"), F.col("_m").alias("_r"))
            jumped = cut(least.join(root, "_m").select("_v", F.least("_m", "_r").alias("_m")))
            settled = jumped.withColumnRenamed("_m", "_n").join(labels, "_v").where("_n <> _m").isEmpty()
            labels = jumped
            if settled:
                break
        else:
            raise RuntimeError("components didn't settle")
        roots = labels.select(F.col("_v").alias("_c"), "_m")
        cells = cells.join(roots, "_c", "left").select("ix", "iy", F.coalesce("_m", "_c").alias("_c"))
    numbered = ranked(cells.select("_c").distinct(), ["_c"], "_n").select("_c", (F.col("_n") + 1).cast("int").alias("component"))
    return cells.join(numbered, "_c").select("ix", "iy", "component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("cells"))


def largest_component(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """Cells of the largest component, the first of equal ones."""
    labelled = cut(components(mask, connectivity))
    top = component_sizes(labelled).orderBy(F.desc("cells"), "component").limit(1).select("component")
    return labelled.join(top, "component").select("ix", "iy")


def without_small(mask: DataFrame, least: int, connectivity: int = 8) -> DataFrame:
    labelled = cut(components(mask, connectivity))
    return labelled.join(component_sizes(labelled).where(F.col("cells") >= least), "component").select("ix", "iy")


def background(mask: DataFrame, nx: int, ny: int, connectivity: int = 4) -> DataFrame:
    """Components of the cells outside the mask, and whether each touches the border of the grid."""
    empty = grid(mask.sparkSession, nx, ny).join(mask, ["ix", "iy"], "left_anti")
    labelled = cut(components(empty, connectivity))
    edge = (F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == nx - 1) | (F.col("iy") == ny - 1)
    touch = labelled.groupBy("component").agg(F.max(edge).alias("touches"), F.count("*").alias("cells"))
    return labelled.join(touch, "component")


def holes(mask: DataFrame, nx: int, ny: int, connectivity: int = 4) -> DataFrame:
    """Cells of background components that don't reach the border."""
    return background(mask, nx, ny, connectivity).where("NOT touches").drop("touches")


def exterior_boundary(mask: DataFrame, nx: int, ny: int) -> DataFrame:
    """Mask cells that have a border-connected background cell among their four neighbours; the grid's edge isn't one."""
    outside = background(mask, nx, ny, 4).where("touches").select("ix", "iy")
    return neighbours(outside, FOUR).select("ix", "iy").distinct().join(mask, ["ix", "iy"], "left_semi")


def fill_holes(mask: DataFrame, nx: int, ny: int, most_cells: int | None = None, most_share: float | None = None, connectivity: int = 4) -> DataFrame:
    """mask with its holes, or with those of at most most_cells, or at most most_share of the mask's cells."""
    found = holes(mask, nx, ny, connectivity)
    if most_cells is not None:
        found = found.where(F.col("cells") <= most_cells)
    if most_share is not None:
        found = found.where(F.col("cells") <= most_share * mask.count())
    return mask.select("ix", "iy").unionByName(found.select("ix", "iy")).distinct()


def closed(mask: DataFrame, nx: int, ny: int, times: int = 1) -> DataFrame:
    return erode(dilate(mask, nx, ny, times), nx, ny, times)


#: Mask repairs by name; unknown cells are taken out last.
METHODS = {
    "none": lambda m, nx, ny: m,
    "largest": lambda m, nx, ny: largest_component(m),
    "drop_small": lambda m, nx, ny: without_small(m, 3),
    "fill_holes": lambda m, nx, ny: fill_holes(m, nx, ny),
    "fill_small_holes": lambda m, nx, ny: fill_holes(m, nx, ny, most_cells=4, most_share=0.2),
    "close": lambda m, nx, ny: closed(m, nx, ny),
    "close_largest": lambda m, nx, ny: largest_component(closed(m, nx, ny)),
    "fill_largest": lambda m, nx, ny: largest_component(fill_holes(m, nx, ny)),
    "drop_small_fill": lambda m, nx, ny: fill_holes(without_small(m, 3), nx, ny),
}


def repair(mask: DataFrame, method: str, nx: int, ny: int, unknown: DataFrame | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    out = METHODS[method](mask.select("ix", "iy"), nx, ny)
    return out.join(unknown, ["ix", "iy"], "left_anti") if unknown is not None else out


def seeded_basins(raster: DataFrame, value: str, level, seeds: DataFrame, connectivity: int = 8) -> DataFrame:
    """Components of cells below a level, with cells, seeds in them and status: selected if seeded, else ambiguous."""
    low = raster.where(F.col(value) < level).select("ix", "iy")
    labelled = cut(components(low, connectivity))
    seeded = labelled.join(seeds.select("ix", "iy").distinct().withColumn("_seed", F.lit(1)), ["ix", "iy"], "left")
    return seeded.groupBy("component").agg(F.count("*").alias("cells"), F.count("_seed").alias("seeds")).withColumn("status", F.when(F.col("seeds") > 0, "selected").otherwise("ambiguous"))


def trusted_interface(water: DataFrame, unknown: DataFrame, nx: int, ny: int) -> DataFrame:
    """Steps from water cells to each of four neighbours that isn't water: edge, unknown or trusted."""
    around = neighbours(water.select("ix", "iy"), FOUR).join(water.select("ix", "iy"), ["ix", "iy"], "left_anti")
    marked = around.join(unknown.select("ix", "iy").distinct().withColumn("_u", F.lit(True)), ["ix", "iy"], "left")
    return marked.select(F.col("sx").alias("ix"), F.col("sy").alias("iy"), F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.when(~within(nx, ny), "edge").when(F.col("_u"), "unknown").otherwise("trusted").alias("kind"))


def overlap_metrics(predicted: DataFrame, truth: DataFrame, excluded: DataFrame | None = None, rule: str = "floor_one") -> DataFrame:
    """One row: cells, intersection, union, IoU, precision, recall, F1, false ones, area error.

    rule says what a ratio with denominator 0 is: floor_one divides by at least 1, null and zero give that.
    """
    ratio = {"floor_one": ratio_floor_one, "null": ratio_or_null, "zero": ratio_or_zero}[rule]
    p, t = (m.select("ix", "iy").distinct() for m in (predicted, truth))
    both = p.withColumn("_p", F.lit(1)).join(t.withColumn("_t", F.lit(1)), ["ix", "iy"], "full")
    if excluded is not None:
        both = both.join(excluded.select("ix", "iy").distinct(), ["ix", "iy"], "left_anti")
    n = both.agg(F.count("_p").alias("predicted"), F.count("_t").alias("truth"), F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("intersection"), F.count("*").alias("union_cells"))
    i, p, t = F.col("intersection"), F.col("predicted"), F.col("truth")
    return n.select("*", ratio(i, F.col("union_cells")).alias("iou"), ratio(i, p).alias("precision"), ratio(i, t).alias("recall"), ratio(2 * i, p + t).alias("f1"), (p - i).alias("false_positive"), (t - i).alias("false_negative"), ratio(F.abs(p - t), t).alias("area_error"))


def boundary_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: p50, p95, mean and greatest distance between two boundaries, taken from both sides together."""
    both = nearest_distance(a, b).unionByName(nearest_distance(b, a)).where("distance IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.percentile("distance", 0.5).alias("p50"), F.percentile("distance", 0.95).alias("p95"), F.avg("distance").alias("mean"), F.max("distance").alias("max"))


def boundary_f1(predicted: DataFrame, truth: DataFrame, nx: int, ny: int, tolerance: int = 2) -> DataFrame:
    """One row: share of each ring that lies within tolerance cells of the other, and their F1."""
    p, t = cut(inner_ring(predicted)), cut(inner_ring(truth))
    hit = lambda x, y: x.join(dilate(y, nx, ny, tolerance), ["ix", "iy"], "left_semi").agg(F.count("*").alias("h"))
    counts = p.agg(F.count("*").alias("np")).crossJoin(t.agg(F.count("*").alias("nt"))).crossJoin(hit(p, t).withColumnRenamed("h", "hp")).crossJoin(hit(t, p).withColumnRenamed("h", "ht"))  # one row each
    precision, recall = ratio_or_zero(F.col("hp"), F.col("np")), ratio_or_zero(F.col("ht"), F.col("nt"))
    return counts.select(precision.alias("precision"), recall.alias("recall"), ratio_or_zero(2 * precision * recall, precision + recall).alias("f1"))


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of edges crosses the ray to the right of (x, y)."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]]):
        if y0 == y1:
            continue
        at = F.lit(float(x0)) + (y - F.lit(float(y0))) * F.lit((x1 - x0) / (y1 - y0))
        crossings = crossings + (((F.lit(float(y0)) > y) != (F.lit(float(y1)) > y)) & (x < at)).cast("int")
    return crossings % 2 == 1
