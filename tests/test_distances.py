"""Exact distances against all pairs, near and far, sparse and dense."""

import random
import time

import numpy as np
import pytest
from fluvial.operators import joins

CELL = "ix long, iy long"


def plainly(a, b):
    t = np.array(sorted(b))
    return {c: float(np.sqrt(((t - np.array(c)) ** 2).sum(axis=1).min())) for c in a}


def masks():
    r = random.Random(9)
    blob = lambda x, y, n, m: {(x + i, y + j) for i in range(n) for j in range(m) if r.random() < 0.7}
    return {
        "near": (blob(0, 0, 12, 9), blob(3, 4, 12, 9)), "far": (blob(0, 0, 9, 7), blob(400, -300, 6, 8)), "mixed": (blob(0, 0, 6, 6) | blob(900, 5, 5, 5), blob(4, 4, 5, 5) | {(-700, 40)}),
        "one": ({(5, 5)}, {(5, 5)}), "column": ({(0, k) for k in range(40)}, {(1000, 20)}), "scattered": ({(r.randint(-500, 500), r.randint(-500, 500)) for _ in range(80)}, {(r.randint(-500, 500), r.randint(-500, 500)) for _ in range(15)}),
    }


@pytest.mark.parametrize("name", sorted(masks()))
@pytest.mark.parametrize("near", [0, 64])
def test_distances_equal_all_pairs(spark, name, near):
    a, b = masks()[name]
    found = {(r.ix, r.iy): r.distance for r in joins.nearest_distance(spark.createDataFrame(sorted(a), CELL), spark.createDataFrame(sorted(b), CELL), near=near).collect()}
    assert found == pytest.approx(plainly(a, b))


def test_envelope_equals_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(r.integers(-50, 50, r.integers(1, 30)))
        f, at = r.integers(0, 400, len(x)) ** r.integers(1, 3), r.integers(-80, 80, 20)
        assert (joins._envelope(x, f, at) == ((at[:, None] - x) ** 2 + f).min(axis=1)).all()


def test_no_cells(spark):
    none, one = spark.createDataFrame([], CELL), spark.createDataFrame([(1, 2), (1, 2)], CELL)
    assert joins.nearest_distance(none, one).collect() == []
    assert [r.distance for r in joins.nearest_distance(one, none).collect()] == [None]


def test_many_far_cells(spark):
    """Two masks of 40,000 cells far apart: all pairs would be 1.6 * 10 ** 9."""
    square = lambda x: spark.range(40_000).selectExpr(f"id % 200 + {x} AS ix", "floor(id / 200) AS iy")
    began = time.time()
    found = joins.nearest_distance(square(0), square(5000)).groupBy("ix").agg({"distance": "max", "iy": "count"}).collect()
    assert time.time() - began < 100
    assert {r.ix: (r["max(distance)"], r["count(iy)"]) for r in found} == {x: (5000.0 - x, 200) for x in range(200)}
