"""Failures as rows, agreement of halves, and stable images."""

import random

import numpy as np
import pytest
from fluvial.operators import evidence, sequences, stages
from pyspark.sql import functions as F


def test_a_fault_in_each_stage_keeps_its_row(spark):
    rows = spark.createDataFrame([(k, k * 1.0) for k in range(8)], "k long, v double")
    seen = []

    def run(name, change):
        def go(df):
            seen.append((name, sorted(r.k for r in df.select("k").collect())))
            return change(df)

        return go

    plan = [
        stages.Stage("one", run("one", lambda d: d.withColumn("a", F.col("v") * 2)), lambda: [("first", F.col("a") == 0), ("second", F.col("a") <= 2)]),
        stages.Stage("two", run("two", lambda d: d.where("k <> 3").withColumn("b", F.when(F.col("k") != 4, F.col("a") + 1))), lambda: [("no_b", F.col("b").isNull())]),
        stages.Stage("three", run("three", lambda d: d.withColumn("c", F.col("b") + F.col("v"))), lambda: [("large", F.col("c") > 20)]),
    ]
    found = {r.k: r for r in stages.run_stages(rows, ["k"], plan).collect()}
    assert {k: (r.failed_stage, r.reason) for k, r in found.items()} == {
        0: ("one", "first"), 1: ("one", "second"), 2: (None, None), 3: ("two", "no_result"), 4: ("two", "no_b"), 5: (None, None), 6: (None, None), 7: ("three", "large"),
    }
    assert seen == [("one", [*range(8)]), ("two", [*range(2, 8)]), ("three", [2, 5, 6, 7])]
    assert (found[1].a, found[1].b, found[3].v, found[3].a, found[3].b, found[4].a, found[7].c) == (2.0, None, 3.0, 6.0, None, 8.0, 22.0)
    counts = {(r.failed_stage, r.reason): r.n for r in stages.failure_counts(stages.run_stages(rows, ["k"], plan)).collect()}
    assert sum(counts.values()) == 8 and counts[None, None] == 3


def test_stages_that_break_the_contract(spark):
    rows = spark.createDataFrame([(1, 2.0)], "k long, v double")
    with pytest.raises(ValueError, match="twice"):
        stages.run_stages(rows, ["k"], [stages.Stage("s", lambda d: d.union(d))])
    with pytest.raises(ValueError, match="loses"):
        stages.run_stages(rows, ["k"], [stages.Stage("s", lambda d: d.drop("v"))])
    assert stages.run_stages(rows.where("false"), ["k"], [stages.Stage("s", lambda d: d)]).collect() == []


def test_temporal_prediction_names_each_failure(spark):
    track = "image string, t int, u double, v double, maximum_area double, duration_frames int, classification string, confidence double, water_probability double"
    water, strong = "water_ripple", (900.0, 15)
    rows = [("steady", t, 20.0, 20.0, *strong, water, 1.0, 1.0) for t in (0, 1, 8, 9)] + [("moves", t, x, 20.0, *strong, water, 1.0, 1.0) for t, x in ((0, 10.0), (8, 32.0), (9, 54.0))]
    rows += [("weak", t, 20.0, 20.0, *strong, water, 0.01, 1.0) for t in (0, 9)] + [("dry", t, 20.0, 20.0, *strong, "dry_splash", 1.0, 0.0) for t in (0, 9)]
    tracks, images = spark.createDataFrame(rows, track), spark.createDataFrame([(i,) for i in ("steady", "moves", "weak", "dry", "none")], "image string")
    run = lambda **k: {r.image: r for r in stages.temporal_prediction(tracks, images, ["image"], 64, 36, "t", F.lit(5), **k).collect()}
    found = run()
    assert {i: (r.failed_stage, r.reason) for i, r in found.items()} == {
        "steady": (None, None), "moves": ("stability", "half_sequence_disagrees"), "weak": ("evidence", "no_water"), "dry": ("tracks", "no_water_tracks"), "none": ("tracks", "no_water_tracks"),
    }
    assert found["steady"].iou > 0.5 > found["moves"].iou and found["weak"].iou is None
    hybrid = run(model={"most_weight": 1.0})
    assert hybrid["weak"].reason == "no_water" and hybrid["weak"].greatest > found["weak"].greatest  # a model doesn't add water
    assert hybrid["steady"].water_pixels == found["steady"].water_pixels


@pytest.mark.parametrize("model", [None, {"most_weight": 0.9, "scale": 2.0}, {"reach": 12.0}])
def test_temporal_prediction_sums_tracks_once(spark, monkeypatch, model):
    draw, passes, tiled = random.Random(5), [], evidence.kernel_tiles
    kinds, size = ["water_ripple", "water_ripple", "dry_splash", None], (80, 70)  # four tiles
    rows = [(i % 4, t, draw.uniform(0, 85), draw.uniform(0, 75), draw.uniform(1, 120), draw.randint(1, 20), draw.choice(kinds), draw.choice([None, draw.random()]), draw.choice([None, draw.random()])) for i in range(16) for t in range(10)]
    tracks = spark.createDataFrame(rows, "image int, t int, u double, v double, maximum_area double, duration_frames int, classification string, confidence double, water_probability double").coalesce(2)
    monkeypatch.setattr(evidence, "kernel_tiles", lambda *a, **k: passes.append(1) or tiled(*a, **k))
    found = {r.image: r for r in stages.temporal_prediction(tracks, tracks, ["image"], *size, "t", F.lit(5), least_iou=0.0, model=model, close=3, unknown_below=1.0).collect()}
    assert len(passes) == (3 if model and "reach" in model else 1)
    whole = evidence.rule_evidence(tracks, ["image"], *size, close=3, unknown_below=1.0)
    early = evidence.rule_evidence(tracks.withColumn("classification", F.when(F.col("t") < 5, F.col("classification"))), ["image"], *size, close=3, unknown_below=1.0)
    both = whole if model is None else evidence.hybrid(whole, evidence.model_evidence(tracks, ["image"], *size, **model), ["image"])
    greatest = {r.image: r.p for r in both.groupBy("image").agg(F.max("probability").alias("p")).collect()}
    want = {r.image: r for r in stages.mask_agreement(early, whole, ["image"]).collect()}
    assert len(found) == 4 and sum(0 < r.iou < 1 for r in want.values()) > 1
    for i, r in found.items():
        assert r.water_pixels == want[i].water_pixels and r.iou == pytest.approx(want[i].iou) and r.greatest == pytest.approx(greatest[i])


@pytest.mark.parametrize("skip, take", [(0, 1), (2, 4), (1, 5)])
def test_stable_image_is_the_rounded_median(spark, skip, take):
    draw = random.Random(skip)
    frames = [(s, f * 3, u, c, draw.choice([0, 255, draw.randint(0, 255)])) for s in "ab" for f in range(7 if s == "a" else 4) for u in range(3) for c in "rg"]
    rows = spark.createDataFrame(frames + [("a", 9, 0, "r", None)], "s string, f int, u int, c string, v int").repartition(3)
    found = {(r.s, r.u, r.c): r for r in sequences.stable_image(rows, ["s"], "f", ["u", "c"], "v", skip, take).collect()}
    for (s, u, c), r in found.items():
        own = [v for a, f, b, d, v in frames if (a, b, d) == (s, u, c) and skip * 3 <= f < (skip + take) * 3]
        enough = (7 if s == "a" else 4) >= skip + take
        assert r.n == len(own) and r.median == (int(np.median(own).round()) if enough else None)
    assert len(found) == 12
