"""Queries on frames of generated pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import geometry, vision
from fluvial.plans.adapters import frames
from fluvial.plans.registry import query, r4
from fluvial.plans.streams import CAMERA, GRID

W, H = 64, 48


def _pixels(spark, d):
    """Frames of residuals, one for each twelve frames of a sequence: each event lights a small disc, brighter with its value."""
    c = F.col
    spots = frames(spark, d).select(c("seq").alias("sample"), F.floor(c("frame") / 12).alias("window"), (c("v") % 58 + 3).cast("int").alias("u"), ((c("v") * 7) % 42 + 3).cast("int").alias("w"), (c("v") / 10 + 5).alias("bright"), F.when(c("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 5))
    lit = spots.withColumn("o", F.explode(around)).select("sample", "window", (c("w") + c("o.j")).alias("row"), (c("u") + c("o.i")).alias("col"), "bright", (c("bright") * c("sign")).alias("s"))
    return lit.groupBy("sample", "window", "row", "col").agg(F.max("bright").alias("absolute"), F.sum("s").alias("signed"))


@query("candidate_detection")
def candidate_detection(spark, d):
    found = vision.detect_candidates(_pixels(spark, d), ["sample", "window"], W, H, percentile=90.0, areas=(4, 600))
    return found.select("sample", "window", "candidate_id", r4("u"), r4("v"), "area", r4("mean_residual"), "polarity", r4("eccentricity"), r4("compactness"), r4("ringness"))


def _water(spark, d):
    """A lake whose middle moves with the sample, some unknown pixels beside it."""
    c = F.col
    grid = spark.range(5 * W * H).select((c("id") % 5).cast("int").alias("sample"), F.floor(c("id") / 5 / W).cast("int").alias("row"), (F.floor(c("id") / 5) % W).cast("int").alias("col"))
    r = F.hypot(c("col") - 28 - c("sample"), (c("row") - 24) * 1.4)
    return grid.withColumn("probability", F.greatest(F.lit(0.0), 1 - r / 24)).withColumn("state", F.when(r < 12, "water").when((c("row") + c("col")) % 17 == 0, "unknown").otherwise("dry"))


@query("prompt_points")
def prompt_points(spark, d):
    found = vision.prompts(_water(spark, d), ["sample"], W, H)
    text = lambda n: F.to_json(n).alias(n)
    return found.select("sample", "status", F.concat_ws(";", "reasons").alias("reasons"), text("box"), text("positive"), text("negative"))


@query("ranked_components")
def ranked_components(spark, d):
    rows = _pixels(spark, d).select("sample", "window", (F.floor(F.col("row") / 12) * 6 + F.floor(F.col("col") / 12)).alias("component"), (F.col("absolute") / 100).alias("probability"))
    return vision.ranked_components(rows, ["sample", "window"]).select("sample", "window", "component", r4("mass"), "area", "rank", "rivals")


@query("shoreline_samples")
def shoreline_samples(spark, d):
    return vision.shorelines(_water(spark, d).where("state = 'water'").select("sample", "row", "col"), ["sample"], W, H, 32).select("sample", "n", r4("x"), r4("y"))


@query("seed_pixels", f"WITH g AS (SELECT (id % 5)::INTEGER AS sample, floor(id / 5 / {W})::INTEGER AS row, (floor(id / 5) % {W})::INTEGER AS col FROM range({5 * W * H}) t(id)), w AS (SELECT * FROM g WHERE sqrt(power(col - 28 - sample, 2) + power((row - 24) * 1.4::DOUBLE, 2)) < 12), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY row, col) - 1 AS r, count(*) OVER (PARTITION BY sample) AS n FROM w) SELECT sample, row, col FROM r WHERE r IN (SELECT floor(k * (n - 1) / 31.0::DOUBLE) FROM range(32) t(k))")
def seed_pixels(spark, d):
    return vision.seed_pixels(_water(spark, d).where("state = 'water'").select("sample", "row", "col"), ["sample"], 32)


@query("phase_shift")
def phase_shift(spark, d):
    water = _water(spark, d).withColumn("a", F.col("state") == "water")
    moved = water.select("sample", (F.col("row") + 3).alias("row"), (F.col("col") - 2).alias("col"), F.col("a").alias("b"))
    both = water.select("sample", "row", "col", "a").join(moved, ["sample", "row", "col"], "left").withColumn("b", F.coalesce("b", F.lit(False)))
    return vision.shift_between(both, ["sample"], W, H).select("sample", "dx", "dy", r4("response"))


@query("surface_reprojection")
def surface_reprojection(spark, d):
    wet = geometry.scene(spark, GRID).where("z < -0.1").select("x", "y")
    return vision.reprojected(wet, CAMERA, GRID.size, F.lit(-0.1)).groupBy("row").agg(F.count("*").alias("pixels"), F.min("col").alias("first"), F.max("col").alias("last"))
