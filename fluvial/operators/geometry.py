"""Camera rays, height models and scenes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Pinhole camera without roll: position, yaw and pitch (down is positive), horizontal field of view, image size."""

    x: float
    y: float
    z: float
    yaw: float
    pitch: float
    fov: float
    width: int
    height: int

    @property
    def focal(self) -> float:
        return self.width / (2 * math.tan(self.fov / 2))

    def ray(self, u: Column, v: Column) -> tuple[Column, Column, Column]:
        """Unit direction of a pixel in the map frame (x forward at yaw 0, y left, z up)."""
        a, b = (u - F.lit((self.width - 1) / 2)) / self.focal, (v - F.lit((self.height - 1) / 2)) / self.focal
        cy, sy, cp, sp = math.cos(self.yaw), math.sin(self.yaw), math.cos(self.pitch), math.sin(self.pitch)
        n = F.sqrt(1 + a * a + b * b)
        forward, up = F.lit(cp) - b * sp, -F.lit(sp) - b * cp
        return (forward * cy + a * sy) / n, (forward * sy - a * cy) / n, up / n

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Pixel (u, v) and depth before the camera of a point; a depth that isn't positive has no pixel."""
        dx, dy, dz = x - self.x, y - self.y, z - self.z
        cy, sy, cp, sp = math.cos(self.yaw), math.sin(self.yaw), math.cos(self.pitch), math.sin(self.pitch)
        forward, right = dx * cy + dy * sy, dx * sy - dy * cy
        depth, down = forward * cp - dz * sp, -forward * sp - dz * cp
        ok = depth > 1e-9
        return F.when(ok, self.focal * right / depth + (self.width - 1) / 2), F.when(ok, self.focal * down / depth + (self.height - 1) / 2), depth


@dataclass(frozen=True)
class Grid:
    """Cell centres of a grid about the origin: nx by ny cells of a size."""

    nx: int
    ny: int
    size: float

    def centre(self, i: Column, n: int) -> Column:
        return -n * self.size / 2 + self.size * (i + 0.5)


def scene(spark: SparkSession, grid: Grid, slope: float = 0.01, basin_depth: float = 0.4, rx: float = 3.0, ry: float = 2.0) -> DataFrame:
    """Analytic ground: a plane that falls along x with an elliptical basin in the middle; (ix, iy, x, y, z)."""
    cells = spark.range(grid.nx * grid.ny).select((F.col("id") % grid.nx).cast("int").alias("ix"), F.floor(F.col("id") / grid.nx).cast("int").alias("iy"))
    cells = cells.withColumns({"x": grid.centre(F.col("ix"), grid.nx), "y": grid.centre(F.col("iy"), grid.ny)})
    r2 = F.col("x") * F.col("x") / (rx * rx) + F.col("y") * F.col("y") / (ry * ry)
    return cells.withColumn("z", -slope * F.col("x") - F.when(r2 < 1, basin_depth * (1 - r2)).otherwise(0.0))


def water_truth(ground: DataFrame, depth: float, cell_area: float) -> DataFrame:
    """One row: level (lowest ground plus depth), wet cells, area and volume; a dry scene has a null level and zeros."""
    if depth <= 0:
        return ground.limit(1).select(F.lit(None).cast("double").alias("level"), F.lit(0).cast("long").alias("cells"), F.lit(0.0).alias("area"), F.lit(0.0).alias("volume"))
    level = ground.agg((F.min("z") + depth).alias("level"))
    wet = ground.crossJoin(F.broadcast(level)).where("z < level")  # one row
    return wet.groupBy("level").agg(F.count("*").alias("cells"), (F.count("*") * cell_area).alias("area"), (F.sum(F.col("level") - F.col("z")) * cell_area).alias("volume"))


def dense(ground: DataFrame, grid: Grid, most_cells: int = 4_000_000) -> np.ndarray:
    """Height model as an array (ny, nx), NaN where there is none; a grid larger than most_cells is refused."""
    if grid.nx * grid.ny > most_cells:
        raise ValueError("grid too large to hold in one piece")
    out = np.full((grid.ny, grid.nx), np.nan)
    rows = ground.select("ix", "iy", "z").toPandas()
    out[rows.iy, rows.ix] = rows.z
    return out


def bilinear(z: np.ndarray, grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights between four cell centres; NaN outside them or beside a missing cell."""
    u, v = (x + grid.nx * grid.size / 2) / grid.size - 0.5, (y + grid.ny * grid.size / 2) / grid.size - 0.5
    i, j = np.floor(u).astype(int), np.floor(v).astype(int)
    ok = (i >= 0) & (j >= 0) & (i + 1 < grid.nx) & (j + 1 < grid.ny)
    i, j = np.where(ok, i, 0), np.where(ok, j, 0)
    a, b = u - i, v - j
    h = z[j, i] * (1 - a) * (1 - b) + z[j, i + 1] * a * (1 - b) + z[j + 1, i] * (1 - a) * b + z[j + 1, i + 1] * a * b
    return np.where(ok, h, np.nan)


def intersect_rays(pixels: DataFrame, ground: np.ndarray, grid: Grid, camera: Camera, step: float = 0.05, reach: float = 40.0, halvings: int = 20) -> DataFrame:
    """pixels (u, v and others) with hit, reason, and x, y, z where the ray first goes below ground.

    Rays march in steps and the first crossing from above is halved; the height model, of checked size, goes
    along with the function. Reasons: hit, no_ground (the ray meets no height at all), no_crossing.
    """
    dx, dy, dz = camera.ray(F.col("u"), F.col("v"))
    rays = pixels.withColumns({"_dx": dx, "_dy": dy, "_dz": dz})
    schema = ", ".join(f"`{n}` {t}" for n, t in pixels.dtypes) + ", reason string, x double, y double, z double"

    def above(d: np.ndarray, t: np.ndarray) -> np.ndarray:
        return camera.z + d[:, 2] * t - bilinear(ground, grid, camera.x + d[:, 0] * t, camera.y + d[:, 1] * t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            d = rows[["_dx", "_dy", "_dz"]].to_numpy(float)
            n = len(d)
            low, high, found, met, before = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool), np.full(n, np.nan)
            for k in range(int(reach / step) + 1):
                t = np.full(n, k * step)
                h = above(d, t)
                met |= np.isfinite(h)
                cross = ~found & (before > 0) & (h <= 0)
                low[cross], high[cross] = t[cross] - step, t[cross]
                found |= cross
                before = h
            for _ in range(halvings):
                middle = (low + high) / 2
                over = above(d, middle) > 0
                low, high = np.where(over, middle, low), np.where(over, high, middle)
            at = (low + high) / 2
            out = rows.drop(columns=["_dx", "_dy", "_dz"]).copy()
            out["reason"] = np.where(found, "hit", np.where(met, "no_crossing", "no_ground"))
            for i, (name, origin) in enumerate((("x", camera.x), ("y", camera.y), ("z", camera.z))):
                out[name] = np.where(found, origin + d[:, i] * at, np.nan)
            yield out

    found = rays.mapInPandas(run, schema)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z")})


def project_cells(cells: DataFrame, camera: Camera, mask: DataFrame) -> DataFrame:
    """cells (x, y, z) with their pixel (row, col), whether the mask (row, col) holds it, and a reason if it can't be told.

    Reasons: missing_height, behind_camera, outside_image, ok. Pixels round halves to even.
    """
    u, v, depth = camera.project(F.col("x"), F.col("y"), F.col("z"))
    placed = cells.withColumns({"col": F.rint(u).cast("int"), "row": F.rint(v).cast("int"), "_depth": depth})
    outside = ~(F.col("col").between(0, camera.width - 1) & F.col("row").between(0, camera.height - 1))
    reason = F.when(F.col("z").isNull(), "missing_height").when(F.col("_depth") <= 1e-9, "behind_camera").when(outside, "outside_image").otherwise("ok")
    told = placed.withColumn("reason", reason).join(mask.select("row", "col").distinct().withColumn("_m", F.lit(True)), ["row", "col"], "left")
    return told.withColumn("in_mask", (F.col("reason") == "ok") & F.coalesce("_m", F.lit(False))).drop("_depth", "_m")
