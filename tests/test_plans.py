"""What plans must and mustn't hold."""

import contextlib
import io

import pytest
from fluvial.operators import grid
from fluvial.plans import adapters, catalog


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


COLUMNS_ONLY = ["grid_percentile_raster", "frame_difference_exposure", "interval_overlap_join", "neighbour_count_selfjoin", "asof_history_lookup", "status_counts_grouping_sets", "track_features", "threshold_gate", "warning_level_strict", "weighted_median_level", "latest_by_sample"]


@pytest.mark.parametrize("name", COLUMNS_ONLY)
def test_no_python_and_no_product(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert not any(x in text for x in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    lines = adapters.table(spark, sf_dir, "lineitem")
    text = plan(grid.clip_box(lines, {"l_quantity": (10.0, 30.0)}).select("l_orderkey"))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThanOrEqual(l_quantity,30.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_latest_needs_no_sort_of_groups(spark, sf_dir):
    assert "Window" not in plan(catalog.queries()["latest_by_sample"](spark, sf_dir))


def test_rounded_slopes_keep_their_sign(spark):
    import math

    from fluvial.plans.registry import signed4

    rows = spark.createDataFrame([(-1e-18,), (-0.00004,), (0.0,), (-0.00005,), (1e-18,), (None,)], "s double").select(signed4("s")).collect()
    assert [None if r.s is None else (r.s, math.copysign(1, r.s)) for r in rows] == [(0, -1), (0, -1), (0, 1), (-0.0001, -1), (0, 1), None]


def test_slope_of_one_observation_is_as_in_sql(spark, tmp_path):
    import duckdb

    values = ", ".join(f"({i}, {u}, '{c}', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ({i}) MINUTE, {i}.5::DOUBLE)" for i, (u, c) in enumerate([(1, "view"), (1, "click"), (1, "click"), (2, "error"), (1, "click")]))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, user_id, event_type, ts, value)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.queries()["track_features"](spark, str(tmp_path))
    want = con.sql(catalog.oracle_sql()["track_features"])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
