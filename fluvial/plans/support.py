"""Queries on basins that a three-valued mask supports, on the wide grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import support
from fluvial.plans.adapters import WIDE, WIDE_PIXELS, WIDE_RASTER, wide_pixels, wide_raster
from fluvial.plans.registry import query, r4
from fluvial.sources.checkpoints import cut

#: Cells below this price are low; it cuts the grid into many basins.
LEVEL = 25_000.0

_LABELS = """reach(ix, iy, rx, ry) AS (SELECT ix, iy, ix, iy FROM low UNION SELECT r.ix, r.iy, b.ix, b.iy FROM reach r, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j), low b WHERE b.ix = r.rx + i AND b.iy = r.ry + j),
root AS (SELECT ix, iy, min(ry * 1000 + rx) AS root FROM reach GROUP BY ix, iy), labelled AS (SELECT ix, iy, dense_rank() OVER (ORDER BY root)::INTEGER AS component FROM root)"""
_SUPPORT = f"""WITH RECURSIVE {WIDE_RASTER}, {WIDE_PIXELS}, low AS (SELECT ix, iy FROM wide WHERE z < {LEVEL}), {_LABELS}, seeds AS (SELECT DISTINCT ix, iy FROM wide WHERE n >= 12),
sizes AS (SELECT component, count(*) AS cells, count(s.ix) AS seeds FROM labelled l LEFT JOIN seeds s ON s.ix = l.ix AND s.iy = l.iy GROUP BY component),
drawn AS (SELECT DISTINCT component, ix + k AS u, iy AS v FROM labelled, (VALUES (0), (1)) t(k) WHERE (ix + iy) % 3 <> 0),
seen AS (SELECT component, count(*) AS projected, count(*) FILTER (state = 'water') AS water, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'dry') AS dry FROM drawn JOIN px USING (u, v) GROUP BY component),
s AS (SELECT component, cells, seeds, coalesce(projected, 0) AS projected, coalesce(water, 0) AS water, coalesce(unknown, 0) AS unknown, coalesce(dry, 0) AS dry FROM sizes LEFT JOIN seen USING (component)),
p AS (SELECT *, projected - unknown AS known, CASE WHEN projected > unknown THEN water / (projected - unknown)::DOUBLE END AS pr, water / greatest(1, projected)::DOUBLE AS pa FROM s),
j AS (SELECT *, CASE WHEN seeds >= 1 OR (water >= 3 AND pr >= 0.5) THEN 'selected' WHEN projected = 0 THEN 'unobserved' WHEN known = 0 THEN 'unknown_only' WHEN water >= 3 AND pr >= 0.2 THEN 'ambiguous' ELSE 'rejected' END AS status,
  CASE WHEN seeds >= 1 OR (water >= 3 AND pa >= 0.5) THEN 'selected' WHEN projected = 0 THEN 'unobserved' WHEN water >= 3 AND pa >= 0.2 THEN 'ambiguous' ELSE 'rejected' END AS plain FROM p)"""
_THRESHOLDS = {"least_pixels": 3, "least_precision": 0.5, "ambiguous_precision": 0.2}


def _parts(spark, d):
    raster = cut(wide_raster(spark, d))
    footprints = raster.where((F.col("ix") + F.col("iy")) % 3 != 0).select("ix", "iy", F.explode(F.array(F.col("ix"), F.col("ix") + 1)).alias("u"), F.col("iy").alias("v"))
    return raster, raster.where("n >= 12"), footprints, wide_pixels(spark, d)


@query("three_valued_basins", f"{_SUPPORT} SELECT component, cells, seeds, projected, known, water, dry, unknown, round(pr, 4) AS precision, status, status IN ('unobserved', 'unknown_only', 'ambiguous') AS ambiguous FROM j")
def three_valued_basins(spark, d):
    raster, seeds, footprints, pixels = _parts(spark, d)
    _, judged = support.reconstructed(raster, "z", LEVEL, seeds, footprints, pixels, **_THRESHOLDS)
    return judged.select("component", "cells", "seeds", "projected", "known", "water", "dry", "unknown", r4("precision"), "status", "ambiguous")


@query("reconstructed_water", f"{_SUPPORT} SELECT ix, iy, component FROM labelled JOIN j USING (component) WHERE plain = 'selected'")
def reconstructed_water(spark, d):
    raster, seeds, footprints, pixels = _parts(spark, d)
    return support.reconstructed(raster, "z", LEVEL, seeds, footprints, pixels, unknown_aware=False, **_THRESHOLDS)[0]


@query("basin_scene", f"""{_SUPPORT} SELECT count(*) AS candidates, count(*) FILTER (status = 'selected') AS selected, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unobserved') AS unobserved,
count(*) FILTER (status = 'unknown_only') AS unknown_only, count(*) FILTER (status = 'rejected') AS rejected, sum(cells)::BIGINT AS candidate_cells, sum(cells) FILTER (status = 'selected')::BIGINT AS water_cells, sum(seeds)::BIGINT AS valid_seeds,
bool_or(status IN ('unobserved', 'unknown_only', 'ambiguous')) AS ambiguous_scene, sum(seeds) > 0 AND count(*) FILTER (status = 'selected') > 0 AS seed_valid FROM j""")
def basin_scene(spark, d):
    raster, seeds, footprints, pixels = _parts(spark, d)
    return support.scene(support.reconstructed(raster, "z", LEVEL, seeds, footprints, pixels, **_THRESHOLDS)[1])


_SHORE = f"""WITH RECURSIVE {WIDE_PIXELS}, low AS (SELECT u AS ix, v AS iy FROM px WHERE state = 'water'), {_LABELS}, size AS (SELECT max(iy) + 1 AS ny FROM (SELECT v AS iy FROM px)),
big AS (SELECT component FROM labelled GROUP BY component HAVING count(*) >= 6), steps AS (SELECT l.ix, l.iy, l.ix + i AS nx, l.iy + j AS ny, k FROM low l, (VALUES (0, -1, 0), (0, 1, 1), (-1, 0, 2), (1, 0, 3)) t(i, j, k)),
kinds AS (SELECT s.*, CASE WHEN nx < 0 OR nx >= {WIDE} OR s.ny < 0 OR s.ny >= size.ny THEN 'edge' WHEN p.state = 'unknown' THEN 'unknown' ELSE 'trusted' END AS kind FROM steps s CROSS JOIN size LEFT JOIN px p ON p.u = s.nx AND p.v = s.ny WHERE p.state IS DISTINCT FROM 'water'),
pts AS (SELECT k.*, component, row_number() OVER (ORDER BY k.iy, k.ix, k.k) - 1 AS r FROM kinds k JOIN labelled l ON l.ix = k.ix AND l.iy = k.iy JOIN big USING (component) WHERE kind = 'trusted')"""


def _shore(spark, d):
    pixels = cut(wide_pixels(spark, d).select(F.col("u").alias("ix"), F.col("v").alias("iy"), "state"))
    ny = pixels.agg(F.max("iy")).first()[0] + 1
    return support.trusted_shoreline(pixels.where("state = 'water'").select("ix", "iy"), pixels.where("state = 'unknown'").select("ix", "iy"), WIDE, ny, least_pixels=6)


@query("sampled_shoreline", f"{_SHORE} SELECT component, ix, iy, (ix + nx) / 2.0::DOUBLE AS u, (iy + ny) / 2.0::DOUBLE AS v FROM pts WHERE r % 2 = 0")
def sampled_shoreline(spark, d):
    return _shore(spark, d)[0]


@query("shoreline_counts", f"""{_SHORE} SELECT count(*) AS interfaces, count(*) FILTER (kind = 'trusted') AS trusted, count(*) FILTER (kind = 'unknown') AS unknown, count(*) FILTER (kind = 'edge') AS edge,
round(count(*) FILTER (kind = 'trusted') / count(*)::DOUBLE, 4) AS trusted_share, (SELECT count(DISTINCT component) FROM labelled) AS components, (SELECT round(count(*) FILTER (ix < 2 OR ix >= {WIDE - 2} OR iy < 2 OR iy >= ny - 2) / count(*)::DOUBLE, 4) FROM labelled, size) AS edge_touch,
(SELECT count(*) FROM big) AS kept, (SELECT count(*) FROM pts) AS points, (SELECT count(*) FROM pts WHERE r % 2 = 0) AS samples FROM kinds""")
def shoreline_counts(spark, d):
    return _shore(spark, d)[1].select("interfaces", "trusted", "unknown", "edge", r4("trusted_share"), "components", r4("edge_touch"), "kept", "points", "samples")


_APART = f"""WITH {WIDE_RASTER}, {WIDE_PIXELS}, o AS (SELECT u AS ix, v AS iy FROM px WHERE state = 'water'), un AS (SELECT u AS ix, v AS iy FROM px WHERE state = 'unknown'), size AS (SELECT max(v) + 1 AS ny FROM px),
p AS (SELECT ix, iy FROM wide, size WHERE z < 32000 AND iy < size.ny AND (ix, iy) NOT IN (SELECT (ix, iy) FROM un)),
oe AS (SELECT DISTINCT o.ix, o.iy FROM o, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) t(i, j), size WHERE o.ix + i BETWEEN 0 AND {WIDE - 1} AND o.iy + j BETWEEN 0 AND ny - 1 AND (o.ix + i, o.iy + j) NOT IN (SELECT (ix, iy) FROM o) AND (o.ix + i, o.iy + j) NOT IN (SELECT (ix, iy) FROM un)),
pe AS (SELECT DISTINCT o.ix, o.iy FROM p o, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) t(i, j), size WHERE o.ix + i BETWEEN 0 AND {WIDE - 1} AND o.iy + j BETWEEN 0 AND ny - 1 AND (o.ix + i, o.iy + j) NOT IN (SELECT (ix, iy) FROM p) AND (o.ix + i, o.iy + j) NOT IN (SELECT (ix, iy) FROM un)),
dist AS (SELECT a.ix, a.iy, sqrt(min(power(a.ix - b.ix, 2) + power(a.iy - b.iy, 2))) AS d FROM oe a, pe b GROUP BY a.ix, a.iy UNION ALL SELECT a.ix, a.iy, sqrt(min(power(a.ix - b.ix, 2) + power(a.iy - b.iy, 2))) FROM pe a, oe b GROUP BY a.ix, a.iy)"""


def _masks(spark, d):
    pixels = cut(wide_pixels(spark, d).select(F.col("u").alias("ix"), F.col("v").alias("iy"), "state"))
    ny = pixels.agg(F.max("iy")).first()[0] + 1
    low = cut(wide_raster(spark, d).where((F.col("z") < 32_000) & (F.col("iy") < ny)).select("ix", "iy"))
    return pixels.where("state = 'water'").select("ix", "iy"), pixels.where("state = 'unknown'").select("ix", "iy"), low, WIDE, ny


@query("known_reprojection", f"""{_APART},
n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM o) AS no, (SELECT count(*) FROM p JOIN o USING (ix, iy)) AS ni)
SELECT round(ni / greatest(1, np + no - ni)::DOUBLE, 4) AS iou, round(ni / greatest(1, np)::DOUBLE, 4) AS precision, round(ni / greatest(1, no)::DOUBLE, 4) AS recall, np AS predicted_pixels, no AS observed_pixels,
  (SELECT round(avg(d), 4) FROM dist) AS boundary_mean, (SELECT round(quantile_cont(d, 0.95), 4) FROM dist) AS boundary_p95, (SELECT count(*) FROM un) AS unknown_pixels, (SELECT count(*) FROM oe) AS observed_boundary, (SELECT count(*) FROM pe) AS predicted_boundary FROM n""")
def known_reprojection(spark, d):
    found = support.reprojection(*_masks(spark, d))
    return found.select(r4("iou"), r4("precision"), r4("recall"), "predicted_pixels", "observed_pixels", r4("boundary_mean"), r4("boundary_p95"), "unknown_pixels", "observed_boundary", "predicted_boundary")


@query("boundary_diagnostics", f"""{_APART}, ring AS (SELECT o.ix, o.iy FROM o WHERE (SELECT count(*) FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j), o q WHERE q.ix = o.ix + i AND q.iy = o.iy + j) < 9),
touch AS (SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM un WHERE abs(un.ix - ring.ix) <= 1 AND abs(un.iy - ring.iy) <= 1)) AS t FROM ring), every AS (SELECT ix, iy FROM wide, size WHERE z < 32000 AND iy < size.ny)
SELECT (SELECT round(median(d), 4) FROM dist) AS p50, (SELECT round(quantile_cont(d, 0.95), 4) FROM dist) AS p95, (SELECT round(avg(d), 4) FROM dist) AS mean, (SELECT round(avg((d > 1)::INTEGER), 4) FROM dist) AS above_near, (SELECT round(avg((d > 2)::INTEGER), 4) FROM dist) AS above_far,
  (SELECT count(DISTINCT (ix, iy)) FROM dist WHERE d > 2) AS tail_pixels, (SELECT round(coalesce((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) / ({WIDE} * max(ny))::DOUBLE, 0), 4) FROM dist, size WHERE d > 2) AS tail_box, t AS unknown_touching, round(t / greatest(1, n)::DOUBLE, 4) AS unknown_touching_share,
  (SELECT bool_or(ix IN (0, {WIDE - 1}) OR iy IN (0, ny - 1)) FROM every, size) AS touches_border FROM touch""")
def boundary_diagnostics(spark, d):
    found = support.boundary_diagnostics(*_masks(spark, d), near=1.0, far=2.0)
    return found.select(*(r4(c) for c in ("p50", "p95", "mean", "above_near", "above_far")), "tail_pixels", r4("tail_box"), "unknown_touching", r4("unknown_touching_share"), "touches_border")
