"""What large tables broke: order of arrival, rows of one place, sequences of many frames, fits of many rows."""

import random

import numpy as np
import pandas as pd
from fluvial.operators import events, evidence, joins, vision
from fluvial.streaming import tracker
from pyspark.sql import functions as F


def test_tracks_of_an_image_reach_one_range(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 199), r.uniform(0, 64), r.uniform(0, 36), 9.0, 5, "water_ripple", 0.5) for _ in range(2000)]
    tracks = spark.createDataFrame(rows, "image int, u double, v double, maximum_area double, duration_frames int, classification string, confidence double")
    tiles = evidence.kernel_tiles(tracks, ["image"], {"e": F.col("confidence")}, 64, 36, most_tiles=4)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(image" in plan  # else every few tracks hand on whole tiles
    assert tiles.count() == 200


def test_fit_takes_any_number_of_rows(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 250_000) / 8.0, r.integers(0, 5, 250_000)
    y = (a + r.normal(size=len(a)) > 0.5).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y}))
    near = events.fit_logistic(rows, ["a", "b"], "y", steps=5)
    far = events.fit_logistic(rows, ["a", "b"], "y", steps=5, held=10)
    assert np.allclose(near["weights"], far["weights"], atol=1e-12) and abs(near["bias"] - far["bias"]) < 1e-12
    z, w, c = np.stack([(x - x.mean()) / x.std() for x in (a, b)], axis=1), np.zeros(2), np.log(y.mean() / (1 - y.mean()))
    for _ in range(5):
        e = (1 / (1 + np.exp(-(z @ w + c))) - y) / len(y)
        w, c = w - 0.08 * (z.T @ e + 0.02 * w), c - 0.08 * e.sum()
    assert np.allclose(near["weights"], w, atol=1e-9) and abs(near["bias"] - c) < 1e-9


def test_neighbours_of_rows_in_one_place(spark):
    r = random.Random(5)
    rows = [(k, r.choice("ab"), float(r.randint(0, 12)), float(r.randint(0, 12))) for k in range(300)] + [(300, "a", None, 1.0)]
    got = {x.id: x.n for x in joins.neighbour_counts(spark.createDataFrame(rows, "id int, k string, x double, y double"), "x", "y", 3.0, ["k"], "n").collect()}
    near = lambda a, b: a[0] != b[0] and a[1] == b[1] and None not in (a[2], b[2]) and np.hypot(a[2] - b[2], a[3] - b[3]) <= 3.0
    assert got == {a[0]: sum(near(a, b) for b in rows) for a in rows}


def test_neighbours_are_counted_where_they_meet(spark):
    rows = spark.range(50).select(F.lit(1).alias("s"), "id", (F.col("id") % 7).cast("double").alias("u"), F.lit(0.0).alias("v"), F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    found = events.neighbour_context(rows, ["s"], "id", "u", "v", "a", "b", 2.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # pairs aren't joined to their rows again
    want = {i: (sum(i != j and abs(i % 7 - j % 7) <= 2 for j in range(50)), sum(i != j and abs(i % 7 - j % 7) <= 2 and abs(i - j) <= 3 for j in range(50)) / 4) for i in range(50)}
    assert {r.id: (r.neighbour_count, r.local_density) for r in found.collect()} == want


def test_sequences_are_read_frame_by_frame(spark):
    r = random.Random(8)
    rows = [(s, f, 10 * f + k, r.uniform(0, 60), r.uniform(0, 40), r.randint(1, 60), 3.0) for s in (1, 2, None) for f in range(40) for k in range(r.randint(0, 3))]
    df = spark.createDataFrame(rows, "seq long, frame long, candidate_id long, u double, v double, area long, radius double")
    df = df.withColumns({n: (F.col(c) + d).cast("int") for n, c, d in (("x0", "u", -3), ("y0", "v", -3), ("x1", "u", 3), ("y1", "v", 3))}).repartition(3)
    found = events.associate(df, "seq")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # a group would be held whole
    got = {(x.seq, x.frame, x.candidate_id): x.track for x in found.collect()}
    for s in (1, 2, None):
        state = events.OpenTracks()
        for f in range(40):
            own = [dict(zip(("seq", "frame", "candidate_id", "u", "v", "area", "radius"), x)) for x in rows if x[0] == s and x[1] == f]
            own = [c | {"x0": int(c["u"] - 3), "y0": int(c["v"] - 3), "x1": int(c["u"] + 3), "y1": int(c["v"] + 3)} for c in own]
            assert [got[s, f, c["candidate_id"]] for c in own] == state.step(f, own)


def test_a_batch_of_a_sequence_sets_one_timer():
    class Handle:
        def __init__(self):
            self.timers, self.kept = [], []

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

        def appendList(self, rows):  # noqa: N802
            self.kept += rows

    h = Handle()
    fields = list(events.CANDIDATE)
    p = tracker.Association(fields, "", 1000, {})
    p.handle = p.open = h
    rows = pd.DataFrame([[1000 * f, f, f, 1.0, 1.0, 1, 1.0, 0, 0, 2, 2] for f in range(9, 0, -1)], columns=["ms", *fields])
    list(p.handleInputRows((1,), iter([rows[:4], rows[4:]]), None))
    assert h.timers == [1000] and len(h.kept) == 9


def test_frames_cut_over_batches_give_the_same_candidates(spark):
    r = random.Random(4)
    lit = {(s, w, y, x): (r.uniform(3, 30), r.uniform(-30, 30)) for s in (1, None) for w in range(6) for _ in range(9) for y0, x0 in [(r.randint(2, 20), r.randint(2, 28))] for y in range(y0 - 1, y0 + 2) for x in range(x0 - 1, x0 + 2)}
    pixels = spark.createDataFrame([(*k, *v) for k, v in lit.items()], "sample long, window long, row int, col int, absolute double, signed double")
    found = vision.detect_candidates(pixels, ["sample", "window"], 32, 24, percentile=80.0, areas=(4, 600))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(str, found.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(str, found.select("*").collect())) == whole and len(whole) > 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rasters_read_their_points_once(spark, sf_dir):
    from fluvial.plans import adapters

    assert "FileScan" not in adapters.mask(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_many_different_places(spark):
    r = random.Random(7)
    rows = [(k, r.choice(["a", "b", None]) if k % 50 == 0 else "a", r.gauss(0, 4) if k % 3 else r.uniform(-40, 40), r.gauss(0, 4)) for k in range(3000)]
    rows += [(3000 + k, "a", x, y) for k, (x, y) in enumerate([(np.nan, 0.0), (np.inf, 0.0), (np.inf, 0.0), (None, 0.0), (0.0, -0.0), (-0.0, 0.0), (1e12, 1e12), (1e12, 1e12)])]
    found = joins.neighbour_counts(spark.createDataFrame(rows, "id int, k string, x double, y double"), "x", "y", 5.0, ["k"], "n")
    got = {x.id: x.n for x in found.collect()}
    x, y = (np.array([np.nan if p[i] is None or p[1] is None else p[i] for p in rows]) for i in (2, 3))
    keys = np.array([str(p[1]) for p in rows])
    with np.errstate(invalid="ignore"):
        dx, dy = x[:, None] - x, y[:, None] - y
        near = (np.sqrt(dx * dx + dy * dy) <= 5.0) & (keys[:, None] == keys)
    assert got == {p[0]: int(n) - int(near[k, k]) for k, (p, n) in enumerate(zip(rows, near.sum(axis=1)))}
    # places are compared as chunks: no pair of places is a row of the plan
    assert "_whole" in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_at_the_radius_are_as_in_sql(spark, tmp_path):
    import duckdb
    from fluvial.plans import catalog

    pairs = [(1057, 480, 689499, 5040), (1122, 480, 376478, 5040), (8188, 140, 49758, 17280), (1474, 480, 782728, 5040), (14129, 140, 53564, 17280), (10753, 140, 35930, 17280)]  # a root of squares is 5, hypot a little more
    ends = [(n, v, s) for n, (i, a, j, b) in enumerate(pairs) for v, s in ((i / 100, j), ((i + a) / 100, j + b))]
    values = ", ".join(f"({k}, {k % 3}, 'kind {n}', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ({s}) SECOND, {v}::DOUBLE)" for k, (n, v, s) in enumerate(ends))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, user_id, event_type, ts, value)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(catalog.oracle_sql()["neighbour_count_selfjoin"]).fetchall()
    assert {n for _, n in want} == {1}
    assert sorted(map(tuple, catalog.queries()["neighbour_count_selfjoin"](spark, str(tmp_path)).collect())) == sorted(want)
