"""Image helpers against plain definitions."""

import math

import numpy as np
from fluvial.operators import geometry, vision
from pyspark.sql import functions as F


def test_labels_and_distances():
    r = np.random.default_rng(3)
    mask = r.random((17, 23)) < 0.55
    for n in (4, 8):
        want, count = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if want[y, x]:
                continue
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 17 and 0 <= b < 23 and mask[a, b] and not want[a, b]:
                    want[a, b] = count
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (n == 8 or not (i and j))]
        assert (vision.label(mask, n) == want).all()
    zeros = np.argwhere(~mask)
    d = vision.distance_inside(mask)
    for y, x in np.argwhere(mask):
        assert math.isclose(d[y, x], np.hypot(*(zeros - (y, x)).T).min())
    assert (d[~mask] == 0).all() and np.isinf(vision.distance_inside(np.ones((4, 5), bool))).all()


def test_contours():
    mask = np.zeros((9, 9), bool)
    mask[2:6, 1:8] = True
    line = vision.contour(mask)
    assert len(line) == 2 * (6 + 3) and vision.perimeter(mask) == 18
    assert len(vision.resampled(line, 36)) == 36
    single = np.zeros((3, 3), bool)
    single[1, 1] = True
    assert vision.contour(single).tolist() == [[1, 1]] and vision.perimeter(single) == 0


def test_morphology():
    mask = np.zeros((5, 5), bool)
    mask[0, 0] = mask[0, 2] = True
    assert vision.square(vision.square(mask, 3, True), 3, False)[0, 1]
    assert vision.square(np.ones((3, 3), bool), 3, False).all()  # the border doesn't erode


def test_points_keep_their_distance():
    mask = np.ones((30, 40), bool)
    mask[0] = mask[-1] = mask[:, 0] = mask[:, -1] = False
    p = np.ones(mask.shape)
    chosen = vision.spread_points(mask, vision.distance_inside(mask), p, 5, 8.0)
    assert len(chosen) == 5
    assert all(math.dist(a[:2], b[:2]) >= 8 for i, a in enumerate(chosen) for b in chosen[:i])


def test_shift(spark):
    from fluvial.plans import catalog

    rows = catalog.queries()["phase_shift"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.dx, r.dy) for r in rows} == {(-2, 3)}


def test_reprojection_covers_the_square(spark):
    camera = geometry.Camera(0.0, 0.0, 5.0, 0.0, math.pi / 2 - 1e-9, math.radians(60), 101, 101)  # looks straight down
    cells = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    found = {(r.row, r.col) for r in vision.reprojected(cells, camera, 1.0, F.lit(0.0)).collect()}
    half = camera.focal * 0.5 / 5
    want = {(y, x) for y in range(101) for x in range(101) if abs(x - 50) <= half and abs(y - 50) <= half}
    assert found == want
