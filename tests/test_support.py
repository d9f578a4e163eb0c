"""Basins and shorelines under a mask of three values, by hand."""

import pytest
from fluvial.operators import order, support
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

CELL = "ix long, iy long"


def test_each_status(spark):
    # five basins in a row, two cells each, apart from one another
    raster = spark.createDataFrame([(3 * k + i, 0, 1.0) for k in range(5) for i in (0, 1)] + [(2, 0, 9.0), (20, 0, None)], CELL + ", z double")
    seeds = spark.createDataFrame([(0, 0), (0, 0), (2, 0)], CELL)  # repeated, and one above the level
    footprints = spark.createDataFrame([(3 * k + i, 0, 3 * k + i, v) for k in range(5) for i in (0, 1) for v in (0, 1, 1)], CELL + ", u long, v long")
    state = lambda u, v: {1: "water", 2: "unknown", 3: "water" if v == 0 else "dry"}[u // 3]
    pixels = spark.createDataFrame([(u, v, state(u, v)) for u in (3, 4, 6, 7, 9, 10) for v in (0, 1)], "u long, v long, state string")
    water, judged = support.reconstructed(raster, "z", 5.0, seeds, footprints, pixels, least_pixels=2, least_precision=0.9, ambiguous_precision=0.2)
    rows = {r.component: r for r in judged.collect()}
    assert [rows[k].status for k in range(1, 6)] == ["selected", "selected", "unknown_only", "ambiguous", "unobserved"]
    assert (rows[1].seeds, rows[1].projected, rows[2].projected, rows[3].known, rows[3].precision, rows[4].precision) == (1, 0, 4, 0, None, 0.5)
    assert {(r.ix, r.component) for r in water.collect()} == {(0, 1), (1, 1), (3, 2), (4, 2)}
    s = support.scene(judged).first()
    assert (s.candidates, s.selected, s.ambiguous_scene, s.seed_valid, s.water_cells, s.candidate_cells) == (5, 2, True, True, 4, 10)
    plain = support.judged_basins(judged.select("component", "cells", "seeds", "projected", "known", "water", "dry", "unknown"), least_pixels=2, unknown_aware=False)
    assert [r.status for r in plain.orderBy("component").collect()] == ["selected", "selected", "rejected", "ambiguous", "unobserved"]


def test_masks_that_overlap_are_an_error(spark):
    with pytest.raises(PySparkException):
        support.checked(spark.createDataFrame([(0, 0, "water"), (0, 0, "unknown")], "u long, v long, state string")).collect()
    assert support.checked(spark.createDataFrame([(0, 0, "water"), (0, 0, "water")], "u long, v long, state string")).count() == 1


def test_empty_masks(spark):
    none = spark.createDataFrame([], CELL)
    raster = spark.createDataFrame([], CELL + ", z double")
    water, judged = support.reconstructed(raster, "z", 1.0, none, spark.createDataFrame([], CELL + ", u long, v long"), spark.createDataFrame([], "u long, v long, state string"))
    assert water.collect() == [] and judged.collect() == []
    s = support.scene(judged).first()
    assert (s.candidates, s.ambiguous_scene, s.seed_valid) == (0, False, False)
    points, counts = support.trusted_shoreline(none, none, 4, 4)
    assert points.collect() == [] and counts.first().interfaces == 0
    assert support.reprojection(none, none, none, 4, 4).first().iou == 0


def test_shoreline_points_in_order(spark):
    water = spark.createDataFrame([(1, 1), (2, 1), (6, 6)], CELL)
    unknown = spark.createDataFrame([(3, 1)], CELL)
    points, counts = support.trusted_shoreline(water, unknown, 8, 8, least_pixels=2, stride=2)
    # in order: above, below, left of (1, 1), then above, below of (2, 1); every second one
    assert {(r.u, r.v) for r in points.collect()} == {(1.0, 0.5), (0.5, 1.0), (2.0, 1.5)}
    c = counts.first()
    assert (c.interfaces, c.trusted, c.unknown, c.edge, c.components, c.kept, c.points, c.samples) == (10, 9, 1, 0, 2, 1, 5, 3)


def test_reprojection_leaves_unknown_out(spark):
    observed, unknown = spark.createDataFrame([(0, 0), (1, 0)], CELL), spark.createDataFrame([(2, 0)], CELL)
    r = support.reprojection(observed, unknown, spark.createDataFrame([(1, 0), (2, 0), (3, 0)], CELL), 6, 2).first()
    assert (r.predicted_pixels, r.iou, r.precision, r.recall) == (2, 1 / 3, 0.5, 0.5)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranks(spark, parts):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    found = order.ranked(rows, ["k"], "r", parts).collect()
    assert [r.k for r in sorted(found, key=lambda r: r.r)] == sorted(r.k for r in rows.collect())
    assert sorted(r.r for r in found) == list(range(1000))


def test_boundary_diagnostics_by_hand(spark):
    observed = spark.createDataFrame([(x, y) for x in range(2, 5) for y in range(2, 5)], CELL)
    unknown = spark.createDataFrame([(5, 5)], CELL)
    predicted = spark.createDataFrame([(x, y) for x in range(2, 5) for y in range(2, 5)] + [(19, 0)], CELL)
    r = support.boundary_diagnostics(observed, unknown, predicted, 20, 10).first()
    # the eight ring pixels agree, the far pixel lies 15 from (4, 2) in x and 2 in y
    assert (r.tail_pixels, r.touches_border, r.unknown_touching, r.p50) == (1, True, 1, 0.0)
    assert r.tail_box == pytest.approx(1 / 200) and r.above_far == pytest.approx(1 / 17) and r.unknown_touching_share == pytest.approx(1 / 8)
    none = spark.createDataFrame([], CELL)
    e = support.boundary_diagnostics(none, none, none, 4, 4).first()
    assert (e.p50, e.tail_pixels, e.tail_box, e.touches_border, e.unknown_touching_share) == (None, 0, 0.0, False, 0.0)


def test_component_metrics(spark):
    mask = spark.createDataFrame([(0, 0), (1, 0), (0, 1)] + [(5, 5)] + [(9, k) for k in range(4)], CELL)
    m = support.component_metrics(mask, 3).first()
    assert (m.components, m.largest, m.others, m.small_others) == (3, 4, 2, 2)
    m = support.component_metrics(mask, 4).first()
    assert m.small_others == 2
    m = support.component_metrics(mask.where("false")).first()
    assert (m.components, m.largest, m.others, m.small_others) == (0, 0, 0, 0)
