"""Operators that SQL can't say, against plain Python; rules that are easy to get wrong."""

import json
import math
import random
import sqlite3
import struct

import numpy as np
import pandas as pd
import pytest
from fluvial.functions import exprs
from fluvial.operators import events, forecast, gates, geometry, grid, joins, regions, stats
from fluvial.sources import readers, sinks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def cells(spark, points):
    return spark.createDataFrame([(int(x), int(y)) for x, y in points], "ix long, iy long")


def got(df):
    return {(r.ix, r.iy) for r in df.collect()}


def test_ratios_and_rounding(spark):
    one = spark.createDataFrame([(3, 0, 2.5, float("nan"))], "n int, d int, h double, x double")
    r = one.select(exprs.ratio_or_null(F.col("n"), F.col("d")).alias("a"), exprs.ratio_or_zero(F.col("n"), F.col("d")).alias("b"), exprs.ratio_floor_one(F.col("n"), F.col("d")).alias("c"), exprs.half_even_index(F.col("h"), 0.0, 1.0).alias("h"), exprs.finite_or_null(F.col("x")).alias("x")).first()
    assert tuple(r) == (None, 0.0, 3.0, 2, None)


def test_levels(spark):
    df = spark.createDataFrame([(14.9,), (15.0,), (30.0,), (50.0,), (50.1,)], "v double")
    strict = [r[0] for r in df.select(exprs.warning_level(F.col("v"), strict_orange=True)).collect()]
    loose = [r[0] for r in df.select(exprs.warning_level(F.col("v"))).collect()]
    assert strict == ["none", "blue", "yellow", "yellow", "orange"] and loose == ["none", "blue", "yellow", "orange", "orange"]


def test_sparse_cells_keep_their_count(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "ix int, z double")
    found = {r.ix: (r.n, r.q) for r in grid.percentile_raster(df, ["ix"], "z", {"q": 0.2}, 2).collect()}
    assert found == {0: (2, pytest.approx(1.2)), 1: (1, None)}


def test_constant_groups_stay_whole(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 100.0)], "k string, v double")
    assert {(r.k, r.v) for r in stats.robust_filter(df, ["k"], "v").collect()} == {("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)}


def test_strict_join_fails_on_missing_and_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.strict_join(left, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"]).count() == 2
    for right in ([(1, "a")], [(1, "a"), (2, "b"), (2, "c")]):
        with pytest.raises(PySparkException):
            joins.strict_join(left, spark.createDataFrame(right, "k int, v string"), ["k"]).collect()


def test_components_and_holes_against_a_search(spark):
    r = random.Random(4)
    mask = {(x, y) for x in range(18) for y in range(12) if r.random() < 0.5}
    for steps, n in ((regions.FOUR, 4), (regions.EIGHT, 8)):
        left, want = set(mask), []
        while left:
            todo, seen = [min(left, key=lambda c: (c[1], c[0]))], set()
            while todo:
                c = todo.pop()
                if c in left:
                    left.remove(c)
                    seen.add(c)
                    todo += [(c[0] + i, c[1] + j) for i, j in steps]
            want.append(seen)
        for block in (3, 256):  # a component over many blocks, and all in one
            parts = {}
            for row in regions.components(cells(spark, mask), n, block).collect():
                parts.setdefault(row.component, set()).add((row.ix, row.iy))
            assert [parts[k] for k in sorted(parts)] == want
    ring = {(x, y) for x in range(5) for y in range(5)} - {(2, 2)}
    assert got(regions.holes(cells(spark, ring), 8, 8)) == {(2, 2)}
    assert got(regions.fill_holes(cells(spark, ring), 8, 8)) == ring | {(2, 2)}
    assert regions.components(cells(spark, []), 8).count() == 0


def test_distance_is_exact_near_and_far(spark):
    r = random.Random(1)
    a = {(r.randrange(200), r.randrange(200)) for _ in range(60)}
    b = {(r.randrange(40), r.randrange(40)) for _ in range(9)}
    want = {p: min(math.dist(p, q) for q in b) for p in a}
    found = {(x.ix, x.iy): x.distance for x in joins.nearest_distance(cells(spark, a), cells(spark, b)).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[p], want[p]) for p in a)
    assert joins.nearest_distance(cells(spark, a), cells(spark, [])).where("distance is not null").count() == 0


def test_repairs_know_their_names(spark):
    with pytest.raises(ValueError):
        regions.repair(cells(spark, [(0, 0)]), "magic", 4, 4)


def test_association_follows_cheapest_open_track(spark):
    rows = []
    for f in range(6):
        rows.append(("s", f, f * 10, 10.0 + f, 10.0, 9, 1.5))
        if f != 2:
            rows.append(("s", f, f * 10 + 1, 60.0, 40.0 - f, 16, 2.0))
    df = pd.DataFrame(rows, columns=["seq", "frame", "candidate_id", "u", "v", "area", "radius"])
    for c, k, d in (("x0", "u", -2), ("y0", "v", -2), ("x1", "u", 2), ("y1", "v", 2)):
        df[c] = (df[k] + d).astype(int)
    found = events.associate(spark.createDataFrame(df), "seq").toPandas()
    tracks = found.groupby("candidate_id")["track"].first()
    assert tracks[[k for k in tracks.index if k % 10 == 0]].nunique() == 1 and tracks[[k for k in tracks.index if k % 10 == 1]].nunique() == 1 and tracks.nunique() == 2
    assert events.box_iou([0, 0, 1, 1], [1, 1, 2, 2]) == 1 / 7


def test_greedy_match_takes_the_best_first(spark):
    pairs = spark.createDataFrame([("s", 1, 1, 0.9), ("s", 1, 2, 0.8), ("s", 2, 1, 0.85), ("s", 2, 3, 0.1), ("s", 3, 2, 0.8)], "seq string, t int, e int, score double")
    assert {(r.t, r.e) for r in events.greedy_match(pairs, "seq", "t", "e", "score").collect()} == {(1, 1), (3, 2), (2, 3)}


def test_logistic_fit_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=80) * 0.3 > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = events.fit_logistic(df, ["a", "b"], "y", steps=500)
    z, w = np.clip((x - x.mean(0)) / x.std(0), -12, 12), np.zeros(2)
    b = math.log(y.mean() / (1 - y.mean()))
    for _ in range(500):
        e = (1 / (1 + np.exp(-(z @ w + b))) - y) / 80
        w, b = w - 0.08 * (z.T @ e + 0.02 * w), b - 0.08 * e.sum()
    assert np.allclose(sorted(model["weights"]), sorted(w), atol=1e-9) and math.isclose(model["bias"], b, abs_tol=1e-9)
    p = df.select(events.logistic_score([F.col("a"), F.col("b")], model["weights"], model["bias"], model["mean"], model["std"]).alias("p")).toPandas()["p"]
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9
    with pytest.raises(ValueError):
        events.fit_logistic(df, ["a"], "y", most_rows=10)


def test_rays_hit_a_plane_where_they_should(spark):
    g = geometry.Grid(100, 80, 0.1)
    flat = np.zeros((80, 100))
    camera = geometry.Camera(-4.0, 0.0, 2.0, 0.0, 0.6, math.radians(60), 65, 49)
    pixels = spark.createDataFrame([(32.0, 24.0), (32.0, -900.0)], "u double, v double")
    hit, sky = geometry.intersect_rays(pixels, flat, g, camera).orderBy(F.desc("v")).collect()
    assert hit.reason == "hit" and math.isclose(hit.x, -4 + 2 / math.tan(0.6), abs_tol=1e-4) and abs(hit.y) < 1e-9 and abs(hit.z) < 1e-4
    assert sky.reason != "hit" and sky.x is None
    u, v, _ = camera.project(F.lit(hit.x), F.lit(hit.y), F.lit(hit.z))
    back = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert abs(back.u - 32) < 1e-3 and abs(back.v - 24) < 1e-3


def test_forecast_numbers(spark):
    history = spark.createDataFrame([(1, 10, 26.0), (1, 5, 34.0), (1, 1, 42.0), (1, 0, 44.64)], "c int, m int, d double")
    rows = forecast.deterministic_forecast(forecast.depth_history(history, ["c"], "m", "d").withColumn("factor", F.lit(1.3))).orderBy("horizon").collect()
    slope = (0.5 * 2.64 + 0.3 * 10.64 / 5 + 0.2 * 18.64 / 10) * 1.3
    assert all(math.isclose(r.slope, slope) and math.isclose(r.depth, min(100, 44.64 + slope * r.horizon)) for r in rows)
    assert math.isclose(rows[0].minutes_to_orange, (50 - 44.64) / slope) and rows[0].minutes_to_blue == 0
    with pytest.raises(PySparkException):
        forecast.depth_history(history.where("m <> 5"), ["c"], "m", "d").collect()


def test_gate_truth_table(spark):
    rows = spark.createDataFrame([(1, 0.5, 3.0, 20, 1.0), (2, 0.2, 3.0, 20, 1.0), (3, 0.1, 25.0, 5, None), (4, None, None, 20, 6.0)], "id int, valid_ratio double, mean_error double, boundary_cells int, boundary_std double")
    found = {r.id: (r.status, r.reject_reasons) for r in gates.evaluate(rows, gates.coverage_checks() + gates.boundary_checks()).collect()}
    assert found[1][0] == "pass" and found[2][0] == "warning"
    assert found[3] == ("reject", ["low_coverage", "high_mean_error", "too_few_boundary_cells", "boundary_std_unavailable"])
    assert found[4] == ("reject", ["missing_coverage", "missing_mean_error"])


def test_reasons_carry_their_gate(spark):
    rows = spark.createDataFrame([(["a"], None)], "visual array<string>, geometry array<string>")
    assert rows.select(gates.prefixed({"visual": F.col("visual"), "geometry": F.col("geometry")}).alias("r")).first().r == ["visual:a"]


def test_truth_must_not_reach_a_state(spark):
    rows = spark.createDataFrame([(1, 2.0, "tables/ground_truth_depth")], "id int, depth double, src string")
    with pytest.raises(PySparkException):
        gates.canonical_state(rows, ["id"], ["depth"], F.lit(True), "src").collect()


def message(points):
    """A serialised point cloud: x, y, z and intensity as float32."""
    body = bytearray(b"\x00\x01\x00\x00")

    def put(form, value):
        size = struct.calcsize(form)
        body.extend(b"\0" * (-(len(body) - 4) % size))
        body.extend(struct.pack("<" + form, value))

    def blob(raw):
        put("I", len(raw))
        body.extend(raw)

    put("i", 5), put("I", 6), blob(b"lidar\0"), put("I", 1), put("I", len(points)), put("I", 4)
    for i, n in enumerate(("x", "y", "z", "intensity")):
        blob(n.encode() + b"\0"), put("I", 4 * i), put("B", 7), put("I", 1)
    put("B", 0), put("I", 16), put("I", 16 * len(points))
    blob(b"".join(struct.pack("<4f", *p, 1.0) for p in points))
    put("B", 1)
    return bytes(body)


def test_bags(spark, tmp_path):
    (tmp_path / "case7").mkdir()
    db = sqlite3.connect(tmp_path / "case7" / "bag.db3")
    db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.execute("INSERT INTO topics VALUES (1, '/points', 'sensor_msgs/msg/PointCloud2'), (2, '/other', 'std_msgs/msg/String')")
    for k in range(5):
        db.execute("INSERT INTO messages (topic_id, timestamp, data) VALUES (1, ?, ?)", (100 + k, message([(k, 1.5, 2.0), (k, float("nan"), 0.0)])))
    db.commit()
    db.close()
    found = readers.read_bag(spark, str(tmp_path), "/points", max_frames=2, stride=2).orderBy("frame_index").collect()
    assert [(r.case_id, r.frame_index, r.stamp_ns, r.x, r.y, r.z) for r in found] == [("case7", 0, 100, 0.0, 1.5, 2.0), ("case7", 1, 102, 2.0, 1.5, 2.0)]
    for topic in ("/none", "/other"):
        with pytest.raises(PySparkException):
            readers.read_bag(spark, str(tmp_path), topic).collect()


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"frame_{i:03d}.png").write_bytes(bytes([i]))
    frames = readers.read_frames(spark, str(tmp_path))
    assert sorted(r.frame for r in frames.collect()) == [0, 1, 2]
    assert readers.window_digest(frames, 0, 1).first().frames == 2
    (tmp_path / "frame_001.png").unlink()
    with pytest.raises(PySparkException):
        readers.read_frames(spark, str(tmp_path)).collect()
    (tmp_path / "bad.json").write_text('{"a": ')
    with pytest.raises(Exception, match="Malformed"):
        readers.read_json_strict(spark, str(tmp_path / "bad.json"), "a int").collect()
    row = spark.createDataFrame([("/d/wet/heavy/seed_41/frames/x.png",)], "p string").select(*(c.alias(n) for n, c in readers.sequence_identity(F.col("p")).items())).first()
    assert tuple(row) == ("wet", "heavy", 41)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, v double")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert sorted(json.loads(r.value).get("v", None) or 0 for r in spark.read.text(str(tmp_path / "j")).collect()) == [0, 0.5]
    path = str(tmp_path / "t")
    sinks.guarded_append(rows, path, ["k"], {"positive": F.col("k") > 0})
    for bad, rules in ((rows, {}), (spark.createDataFrame([(3, 1.0), (3, 1.0)], rows.schema), {}), (spark.createDataFrame([(-3, 1.0)], rows.schema), {"positive": F.col("k") > 0})):
        with pytest.raises(ValueError):
            sinks.guarded_append(bad, path, ["k"], rules)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(KeyError):
        sinks.keyed_read(spark, path, "k", 9, ["k"])
    model = {"features": ["a"], "weights": [1.0], "bias": 0.5, "mean": [0.0], "std": [1.0]}
    sinks.append(sinks.model_row(spark, model, "v1"), str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m"), "v1")["weights"] == [1.0]
    assert sinks.report(rows.where("k = 1"), "T", [("value", "v")]).first().markdown == "# T\n\n- value: 0.5"


def test_stream_equals_batch(spark, sf_dir):
    from fluvial.plans import catalog

    q = catalog.queries()
    assert sorted(q["stateful_tracker"](spark, sf_dir).collect()) == sorted(q["tracks_per_sequence"](spark, sf_dir).collect())


def test_prediction_reads_no_labels():
    import ast
    from pathlib import Path

    import fluvial

    root = Path(fluvial.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = {n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)}
            assert not any("fluvial.llm" in n for n in names), path


def test_settings():
    from fluvial.sources import config

    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}
    assert config.allowed_path("data/x/../y.json", ["data"]) == "data/y.json"
    for bad in ("/etc/x", "../x", "other/x", "data/ground_truth/x"):
        with pytest.raises(ValueError):
            config.allowed_path(bad, ["data"], ["ground_truth"])
    with pytest.raises(KeyError):
        config.validated({"a": {}}, ["a.b"])
    with pytest.raises(ValueError):
        config.validated({"a": {"b": 5}}, [], {"a.b": (0, 1)})
    with pytest.raises(ValueError):
        config.unique(["a", "a"], "topics")


def test_metadata_and_weather(spark):
    from fluvial.sources import config

    meta = spark.createDataFrame([(None, 0.2)], "grid_size double, resolution double")
    assert meta.select(config.first_present(meta, config.RESOLUTION_NAMES, "r")).first().r == 0.2
    with pytest.raises(KeyError):
        config.first_present(meta, config.BOUNDS_NAMES, "b")
    rows = forecast.weather_correction(spark.createDataFrame([(None,), (20.0,)], "mm double"), "mm").orderBy("mm").collect()
    assert [(r.mm, r.rain_label, r.factor) for r in rows] == [(0.0, "no_rain", 0.7), (20.0, "moderate_rain", 1.3)]
    status = config.path_status(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a", True), ("b", False)], "path string, required boolean"))
    assert config.overall_status(status).first().overall == "warning"


def test_classification_metrics_with_abstention(spark):
    from fluvial.operators import evaluation
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, 0.9), (1, 0, 0.5), (1, 0, 0.1), (0, 1, 0.2), (0, 1, 0.7)], "w int, d int, p double")
    r = evaluation.classification_metrics(rows, F.col("w") == 1, F.col("d") == 1, F.col("p"), 0.4, 0.6).first()
    assert (r.samples, r.water_water, r.water_dry, r.water_uncertain, r.dry_water, r.dry_dry, r.dry_uncertain) == (5, 1, 1, 1, 1, 1, 0)
    assert (r.water_precision, r.water_recall, r.water_f1, r.dry_f1, r.uncertain_rate) == (0.5, 1 / 3, 0.4, 0.5, 0.2)
    assert abs(r.brier_score - (0.01 + 0.25 + 0.81 + 0.04 + 0.49) / 5) < 1e-12
    marked = evaluation.classification_metrics(rows, F.col("w") == 1, F.col("d") == 1, F.col("p"), 0.4, 0.6, F.col("d") == 1).first()
    assert r.noise_called_water == 0 and marked.noise_called_water == marked.dry_water and marked.macro_f1 == r.macro_f1
    empty = evaluation.classification_metrics(rows.limit(0), F.col("w") == 1, F.col("d") == 1, F.col("p"), 0.4, 0.6).first()
    assert (empty.samples, empty.macro_f1, empty.brier_score, empty.uncertain_rate) == (0, 0.0, 0.0, 0.0)


def test_monitor_fails_closed(spark):
    from fluvial.operators import gates

    columns = "downstream_eligible int, authoritative int, warnings_allowed int, outputs_unchanged boolean, formal_executed boolean, ground_truth_used boolean"
    rows = spark.createDataFrame([(0, 0, 0, True, False, False), (0, 0, 1, True, False, False), (0, 0, 0, None, False, False)], columns)
    assert [r.monitor_status for r in gates.monitor(rows).collect()] == ["healthy", "unsafe", "unsafe"]
    found = gates.fault_suite(rows).collect()
    assert [r.rejected for r in found[:9]] == [True] * 9 and not any(r.rejected for r in found[9:])
