"""Queries on points, rasters and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import grid, regions
from fluvial.operators.joins import nearest_distance
from fluvial.plans.adapters import GRID_SQL, NX, NY, POINTS, cells, level_of, mask, mask_sql, points, raster, raster_sql, unknown_cells
from fluvial.plans.registry import query, r4


@query("grid_percentile_raster", f"""WITH {POINTS} SELECT ix, iy, count(*) AS n,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(z, 0.1), 4) END AS p10, CASE WHEN count(*) >= 3 THEN round(quantile_cont(z, 0.2), 4) END AS ground,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(z, 0.5), 4) END AS p50 FROM cells GROUP BY ix, iy""")
def grid_percentile_raster(spark, d):
    found = grid.percentile_raster(cells(spark, d), ["ix", "iy"], "z", {"p10": 0.1, "ground": 0.2, "p50": 0.5}, min_points=3)
    return found.select("ix", "iy", "n", r4("p10"), r4("ground"), r4("p50"))


@query("grid_median_raster", f"WITH {POINTS} SELECT case_id, ix, iy, count(*) AS n, round(median(z), 4) AS z FROM cells GROUP BY case_id, ix, iy")
def grid_median_raster(spark, d):
    return grid.percentile_raster(cells(spark, d), ["case_id", "ix", "iy"], "z", {"z": 0.5}).select("case_id", "ix", "iy", "n", r4("z"))


@query("roi_filter_closed", f"WITH {POINTS} SELECT case_id, count(*) AS n, round(min(z), 4) AS lo, round(max(z), 4) AS hi FROM points WHERE x BETWEEN 10 AND 30 AND z BETWEEN 1000 AND 50000 GROUP BY case_id")
def roi_filter_closed(spark, d):
    kept = grid.clip_box(grid.finite_points(points(spark, d)), {"x": (10, 30), "z": (1000, 50000)})
    return kept.groupBy("case_id").agg(F.count("*").alias("n"), r4(F.min("z"), "lo"), r4(F.max("z"), "hi"))


@query("roi_filter_auto", f"""WITH {POINTS}, k AS (SELECT * FROM points WHERE z >= 2000 AND z < 60000)
SELECT round(floor(min(x) / 5) * 5, 4) AS x_min, round(ceil(max(x) / 5) * 5, 4) AS x_max, round(floor(min(y) / 2) * 2, 4) AS y_min, round(ceil(max(y) / 2) * 2, 4) AS y_max,
  ceil((ceil(max(x) / 5) * 5 - floor(min(x) / 5) * 5) / 5)::BIGINT AS nx, ceil((ceil(max(y) / 2) * 2 - floor(min(y) / 2) * 2) / 2)::BIGINT AS ny FROM k""")
def roi_filter_auto(spark, d):
    found = grid.snapped_extent(grid.clip_box(points(spark, d), {"z": (2000, 60000)}, closed=False), {"x": 5.0, "y": 2.0})
    return found.select(r4("x_min"), r4("x_max"), r4("y_min"), r4("y_max"), "nx", "ny")


@query("raster_summary", f"WITH {POINTS}, {raster_sql()} SELECT count(z) AS n, round(min(z), 4) AS min, round(quantile_cont(z, 0.1), 4) AS p10, round(median(z), 4) AS median, round(quantile_cont(z, 0.9), 4) AS p90, round(max(z), 4) AS max, round(avg(z), 4) AS mean, round(stddev_pop(z), 4) AS std FROM raster")
def raster_summary(spark, d):
    s = grid.value_summary(raster(spark, d), "z")
    return s.select("n", *(r4(c) for c in s.columns if c != "n"))


_DEPTH = """count(*) AS cells, round(count(*) * 0.25::DOUBLE, 4) AS area, round(coalesce(sum(dep) * 0.25::DOUBLE, 0), 4) AS volume, round(coalesce(max(dep), 0), 4) AS max_depth,
  round(coalesce(avg(dep), 0), 4) AS mean_depth, round(coalesce(median(dep), 0), 4) AS median_depth, round(coalesce(min(dep), 0), 4) AS min_depth"""
_LEVEL = "lev AS (SELECT round(quantile_cont(z, 0.5), 4) AS level FROM raster), dep AS (SELECT greatest(0, level - z) AS dep FROM raster, lev)"


@query("depth_area_volume", f"WITH {POINTS}, {raster_sql()}, {_LEVEL} SELECT 'wet' AS rule, {_DEPTH} FROM dep WHERE dep > 0.5 UNION ALL SELECT 'all' AS rule, {_DEPTH} FROM dep")
def depth_area_volume(spark, d):
    rows = raster(spark, d)
    deep = rows.crossJoin(F.broadcast(level_of(rows)))  # one row
    parts = [grid.depth_below_level(deep, "z", F.col("level"), 0.25, w).withColumn("rule", F.lit(n)) for n, w in (("wet", 0.5), ("all", None))]
    both = parts[0].unionByName(parts[1])
    return both.select("rule", "cells", *(r4(c) for c in both.columns if c not in ("rule", "cells")))


_TWO = raster_sql("ground", where="status = 'F'") + ", " + raster_sql("surface", where="status = 'O'")


@query("surface_minus_ground_depth", f"""WITH {POINTS}, {_TWO}, j AS (SELECT ix, iy, s.z AS surface, g.z AS ground FROM surface s FULL JOIN ground g USING (ix, iy))
SELECT ix, iy, surface, ground, CASE WHEN surface - ground IS NULL THEN 'missing' WHEN surface - ground < 0 THEN 'negative' WHEN surface - ground < 5 THEN 'below' WHEN surface - ground > 1500 THEN 'above' ELSE 'valid' END AS status,
  CASE WHEN surface - ground BETWEEN 5 AND 1500 THEN round(surface - ground, 4) END AS depth FROM j""")
def surface_minus_ground_depth(spark, d):
    found = grid.surface_minus_ground(raster(spark, d, where="status = 'O'"), raster(spark, d, where="status = 'F'"), ["ix", "iy"], "z", 5.0, 1500.0)
    return found.select("ix", "iy", "surface", "ground", "status", r4("depth"))


@query("raster_comparison", f"""WITH {POINTS}, {_TWO}, j AS (SELECT s.z AS a, g.z AS b FROM surface s FULL JOIN ground g USING (ix, iy))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS overlap, count(*) AS in_either, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (b IS NOT NULL AND a IS NULL) AS only_b,
  round(avg(a - b), 4) AS mean_difference, round(median(a - b), 4) AS median_difference FROM j""")
def raster_comparison(spark, d):
    found = grid.compare_rasters(raster(spark, d, where="status = 'O'"), raster(spark, d, where="status = 'F'"), ["ix", "iy"], "z")
    return found.select("overlap", "in_either", "only_a", "only_b", r4("mean_difference"), r4("median_difference"))


_SPARSE = "sparse AS (SELECT ix, iy, z FROM raster WHERE (ix * 7 + iy * 3) % 5 <> 0)"


def _fill_sql(circular: bool) -> str:
    near = "power(s.ix - a.ix, 2) + power(s.iy - a.iy, 2) <= 4" if circular else "abs(s.ix - a.ix) <= 2 AND abs(s.iy - a.iy) <= 2"
    return f"""WITH {POINTS}, {raster_sql()}, {_SPARSE}, {GRID_SQL}, m AS (SELECT a.ix, a.iy, s.z, (s.ix - a.ix) * (s.ix - a.ix) + (s.iy - a.iy) * (s.iy - a.iy) AS d2,
  row_number() OVER (PARTITION BY a.ix, a.iy ORDER BY (s.ix - a.ix) * (s.ix - a.ix) + (s.iy - a.iy) * (s.iy - a.iy), s.iy, s.ix) AS r FROM allcells a JOIN sparse s ON {near})
SELECT a.ix, a.iy, m.z, m.d2 AS distance2 FROM allcells a LEFT JOIN m ON a.ix = m.ix AND a.iy = m.iy AND m.r = 1"""


def _filled(spark, d, circular):
    sparse = raster(spark, d).where("(ix * 7 + iy * 3) % 5 <> 0")
    return grid.fill_gaps(sparse, regions.grid(spark, NX, NY), "z", 2, circular)


@query("gap_fill_circular", _fill_sql(True))
def gap_fill_circular(spark, d):
    return _filled(spark, d, True)


@query("gap_fill_square", _fill_sql(False))
def gap_fill_square(spark, d):
    return _filled(spark, d, False)


_MASKS = f"{POINTS}, {mask_sql()}, {mask_sql('truth', 0.5)}, {GRID_SQL}"


def _metrics_sql(where: str) -> str:
    return f"""WITH {_MASKS}, j AS (SELECT ix, iy, m.i IS NOT NULL AS p, t.i IS NOT NULL AS t FROM (SELECT ix, iy, ix AS i FROM mask) m FULL JOIN (SELECT ix, iy, ix AS i FROM truth) t USING (ix, iy)),
n AS (SELECT count(*) FILTER (p) AS predicted, count(*) FILTER (t) AS truth, count(*) FILTER (p AND t) AS intersection, count(*) AS union_cells FROM j WHERE {where})
SELECT predicted, truth, intersection, union_cells, round(intersection / greatest(1, union_cells), 4) AS iou, round(intersection / greatest(1, predicted), 4) AS precision, round(intersection / greatest(1, truth), 4) AS recall,
  round(2 * intersection / greatest(1, predicted + truth), 4) AS f1, predicted - intersection AS false_positive, truth - intersection AS false_negative, round(abs(predicted - truth) / greatest(1, truth), 4) AS area_error FROM n"""


def _metrics(found):
    ratios = ("iou", "precision", "recall", "f1", "area_error")
    return found.select(*(r4(c) if c in ratios else c for c in found.columns))


@query("mask_metrics", _metrics_sql("TRUE"))
def mask_metrics(spark, d):
    return _metrics(regions.overlap_metrics(mask(spark, d), mask(spark, d, 0.5)))


@query("three_valued_mask_metrics", _metrics_sql("ix + iy <> 9"))
def three_valued_mask_metrics(spark, d):
    return _metrics(regions.overlap_metrics(mask(spark, d), mask(spark, d, 0.5), unknown_cells(spark)))


_INNER = "inner_ring AS (SELECT m.ix, m.iy FROM mask m WHERE (SELECT count(*) FROM mask n WHERE abs(n.ix - m.ix) <= 1 AND abs(n.iy - m.iy) <= 1) < 9)"
_GROWN = "grown AS (SELECT a.ix, a.iy FROM allcells a WHERE EXISTS (SELECT 1 FROM mask m WHERE abs(m.ix - a.ix) <= 1 AND abs(m.iy - a.iy) <= 1))"


@query("boundary_cells", f"WITH {_MASKS}, {_INNER} SELECT ix, iy FROM inner_ring")
def boundary_cells(spark, d):
    return regions.inner_ring(mask(spark, d))


@query("outer_ring", f"WITH {_MASKS}, {_GROWN} SELECT ix, iy FROM grown EXCEPT SELECT ix, iy FROM mask")
def outer_ring(spark, d):
    return regions.outer_ring(mask(spark, d), NX, NY)


@query("dilate", f"WITH {_MASKS} SELECT a.ix, a.iy FROM allcells a WHERE EXISTS (SELECT 1 FROM mask m WHERE abs(m.ix - a.ix) <= 2 AND abs(m.iy - a.iy) <= 2)")
def dilate(spark, d):
    return regions.dilate(mask(spark, d), NX, NY, 2)


@query("trusted_interface", f"""WITH {_MASKS}, s AS (SELECT m.ix, m.iy, m.ix + dx AS nx, m.iy + dy AS ny FROM (SELECT * FROM mask EXCEPT SELECT * FROM unknown) m, (VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) o(dx, dy))
SELECT ix, iy, nx, ny, CASE WHEN nx NOT BETWEEN 0 AND 10 OR ny NOT BETWEEN 0 AND 10 THEN 'edge' WHEN (nx, ny) IN (SELECT (ix, iy) FROM unknown) THEN 'unknown' ELSE 'trusted' END AS kind
FROM s WHERE (nx, ny) NOT IN (SELECT (ix, iy) FROM mask EXCEPT SELECT (ix, iy) FROM unknown)""")
def trusted_interface(spark, d):
    water = mask(spark, d).join(unknown_cells(spark), ["ix", "iy"], "left_anti")
    return regions.trusted_interface(water, unknown_cells(spark), NX, NY)


@query("nearest_boundary_distance", f"""WITH {_MASKS}, {_INNER}, t AS (SELECT m.ix, m.iy FROM truth m WHERE (SELECT count(*) FROM truth n WHERE abs(n.ix - m.ix) <= 1 AND abs(n.iy - m.iy) <= 1) < 9)
SELECT a.ix, a.iy, round(min(sqrt(power(a.ix - t.ix, 2) + power(a.iy - t.iy, 2))), 4) AS distance FROM inner_ring a, t GROUP BY a.ix, a.iy""")
def nearest_boundary_distance(spark, d):
    found = nearest_distance(regions.inner_ring(mask(spark, d)), regions.inner_ring(mask(spark, d, 0.5)))
    return found.select("ix", "iy", r4("distance"))


_CORNERS = [(1.2, 0.7), (9.4, 2.1), (7.3, 9.6), (2.2, 8.1)]


def _polygon_sql() -> str:
    terms = []
    for (x0, y0), (x1, y1) in zip(_CORNERS, [*_CORNERS[1:], _CORNERS[0]]):
        terms.append(f"CASE WHEN (({y0} > iy + 0.5) <> ({y1} > iy + 0.5)) AND ix + 0.5 < {x0} + (iy + 0.5 - {y0}) * {(x1 - x0) / (y1 - y0)!r} THEN 1 ELSE 0 END")
    return f"WITH {GRID_SQL} SELECT ix, iy FROM allcells WHERE ({' + '.join(terms)}) % 2 = 1"


@query("point_in_polygon", _polygon_sql())
def point_in_polygon(spark, d):
    return regions.grid(spark, NX, NY).where(regions.in_polygon(F.col("ix") + 0.5, F.col("iy") + 0.5, _CORNERS))


def _components_sql(cells_name: str, four: bool) -> str:
    near = "abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1" if four else "greatest(abs(a.ix - b.ix), abs(a.iy - b.iy)) = 1"
    return f"""reach(ix, iy, rx, ry) AS (SELECT ix, iy, ix, iy FROM {cells_name} UNION SELECT r.ix, r.iy, b.ix, b.iy FROM reach r JOIN {cells_name} a ON r.rx = a.ix AND r.ry = a.iy JOIN {cells_name} b ON {near}),
root AS (SELECT ix, iy, min(ry * 11 + rx) AS root FROM reach GROUP BY ix, iy), labelled AS (SELECT ix, iy, dense_rank() OVER (ORDER BY root)::INTEGER AS component FROM root)"""


@query("connected_components", f"WITH RECURSIVE {_MASKS}, {_components_sql('mask', False)} SELECT ix, iy, component FROM labelled")
def connected_components(spark, d):
    return regions.components(mask(spark, d), 8)


@query("seeded_basins", f"""WITH RECURSIVE {_MASKS}, {_components_sql('mask', False)}
SELECT component, count(*) AS cells, count(*) FILTER (ix = 0 AND iy IN (0, 5)) AS seeds, CASE WHEN count(*) FILTER (ix = 0 AND iy IN (0, 5)) > 0 THEN 'selected' ELSE 'ambiguous' END AS status FROM labelled GROUP BY component""")
def seeded_basins(spark, d):
    rows = raster(spark, d)
    seeds = spark.range(2).select(F.lit(0).cast("long").alias("ix"), (F.col("id") * 5).alias("iy"))
    return regions.seeded_basins(rows.crossJoin(F.broadcast(level_of(rows))), "z", F.col("level"), seeds)  # one row


@query("enclosed_holes", f"""WITH RECURSIVE {_MASKS}, blank AS (SELECT * FROM allcells EXCEPT SELECT * FROM mask), {_components_sql('blank', True)},
t AS (SELECT component FROM labelled GROUP BY component HAVING NOT bool_or(ix IN (0, 10) OR iy IN (0, 10))) SELECT ix, iy FROM labelled WHERE component IN (SELECT component FROM t)""")
def enclosed_holes(spark, d):
    return regions.holes(mask(spark, d), NX, NY).select("ix", "iy")


@query("exterior_boundary", f"""WITH RECURSIVE {_MASKS}, blank AS (SELECT * FROM allcells EXCEPT SELECT * FROM mask), {_components_sql('blank', True)},
t AS (SELECT component FROM labelled GROUP BY component HAVING bool_or(ix IN (0, 10) OR iy IN (0, 10))), o AS (SELECT ix, iy FROM labelled WHERE component IN (SELECT component FROM t))
SELECT m.ix, m.iy FROM mask m WHERE EXISTS (SELECT 1 FROM o WHERE abs(o.ix - m.ix) + abs(o.iy - m.iy) = 1)""")
def exterior_boundary(spark, d):
    return regions.exterior_boundary(mask(spark, d), NX, NY)


@query("topology_methods")
def topology_methods(spark, d):
    found, water = None, mask(spark, d)
    for name in regions.METHODS:
        one = regions.repair(water, name, NX, NY, unknown_cells(spark)).agg(F.count("*").alias("cells")).withColumn("method", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.select("method", "cells")


@query("boundary_metrics")
def boundary_metrics(spark, d):
    water, truth = mask(spark, d), mask(spark, d, 0.5)
    both = regions.boundary_distances(regions.inner_ring(water), regions.inner_ring(truth)).crossJoin(regions.boundary_f1(water, truth, NX, NY, 1))  # one row each
    return both.select("n", *(r4(c) for c in both.columns if c != "n"))
