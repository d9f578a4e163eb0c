"""Frames as pixels: candidates in residuals, prompts from masks, contours, reprojection and shifts.

Each function groups by frame; one frame, of bounded size, is an array in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.operators.geometry import Camera


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component numbers from 1, in scan order of their first pixel; 0 outside the mask."""
    h, w = mask.shape
    big = h * w
    number = np.where(mask, np.arange(big).reshape(h, w), big)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    while True:
        before = number.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            low = np.minimum(number[a], number[b])
            number[a] = np.where(mask[a], low, big)
            number[b] = np.where(mask[b], np.minimum(low, number[b]), big)
        flat = np.append(number.ravel(), big)
        number = np.where(mask, flat[number], big)  # jump to the number that the number's pixel has
        if (number == before).all():
            break
    roots = np.unique(number[mask])
    return np.where(mask, np.searchsorted(roots, number) + 1, 0)


def square(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a square; what lies beyond the image has no say."""
    r = size // 2
    padded = np.pad(mask, r, constant_values=not grow)
    views = [padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def distance_inside(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each pixel of the mask to the nearest one outside; infinite if there is none."""
    h, w = mask.shape
    far = float(h + w)
    down = np.zeros((h, w))
    up = np.zeros((h, w))
    for y in range(h):
        down[y] = np.where(mask[y], (down[y - 1] if y else far) + 1, 0)
        up[h - 1 - y] = np.where(mask[h - 1 - y], (up[h - y] if y else far) + 1, 0)
    column = np.minimum(down, up) ** 2
    column[column >= far * far] = np.inf
    xs = np.arange(w)
    step = (xs[:, None] - xs[None, :]) ** 2
    return np.sqrt(np.stack([(column[y][None, :] + step).min(axis=1) for y in range(h)]))


def perimeter(mask: np.ndarray) -> float:
    """Length of the outer contour through pixel centres: 1 for a straight step, the root of 2 for a diagonal one."""
    line = contour(mask)
    if len(line) < 2:
        return 0.0
    steps = np.abs(np.diff(np.vstack([line, line[:1]]), axis=0)).sum(axis=1)
    return float(np.where(steps == 2, np.sqrt(2), steps).sum())


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer border of the first component, (n, 2) of x, y in order around it."""
    if not mask.any():
        return np.empty((0, 2), int)
    padded = np.pad(mask, 1)
    y, x = np.argwhere(padded)[0]
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from the left
    start, back, line = (y, x), 0, []
    while True:
        line.append((x - 1, y - 1))
        for k in range(1, 9):
            d = (back + k) % 8
            if padded[y + around[d][0], x + around[d][1]]:
                y, x, back = y + around[d][0], x + around[d][1], (d + 5) % 8
                break
        else:
            return np.array(line)
        if (y, x) == start and (len(line) < 2 or (x - 1, y - 1) == line[0]):
            return np.array(line)


def resampled(line: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc lengths around a closed line."""
    closed = np.vstack([line, line[:1]]).astype(float)
    length = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
    at = np.arange(n) * length[-1] / n
    return np.stack([np.interp(at, length, closed[:, 0]), np.interp(at, length, closed[:, 1])], axis=1)


def _shape(mask: np.ndarray, residual: np.ndarray, signed: np.ndarray, top: int = 0, left: int = 0) -> dict:
    """Measures of one component, whose arrays begin at row top and column left of the frame."""
    y, x = np.nonzero(mask)
    y, x = y + top, x + left
    energy, lean = residual[mask], float(signed[mask].mean())
    dy, dx = y - y.mean(), x - x.mean()
    away = np.hypot(dy, dx)
    outer = away >= np.median(away)
    inside = float(energy[~outer].mean()) if not outer.all() else 0.0
    eccentricity = 0.0
    if len(y) >= 3:
        yy, xx, xy = (float(a @ b) / (len(y) - 1) for a, b in ((dy, dy), (dx, dx), (dy, dx)))
        half = math.hypot((yy - xx) / 2, xy)
        low, high = max((yy + xx) / 2 - half, 1e-9), max((yy + xx) / 2 + half, 1e-9)
        eccentricity = math.sqrt(1 - low / high)
    return {
        "u": float(x.mean()), "v": float(y.mean()), "area": len(y), "mean_residual": float(energy.mean()), "max_residual": float(energy.max()), "polarity": "positive" if lean > 0.5 else "negative" if lean < -0.5 else "mixed",
        "eccentricity": eccentricity, "compactness": float(4 * np.pi * len(y) / max(perimeter(mask) ** 2, 1e-9)), "ringness": float(energy[outer].mean() / max(inside, 1e-6)), "radius": float(np.sqrt(len(y) / np.pi)),
    }


def _image(rows: pd.DataFrame, value: str, shape: tuple[int, int], fill: float = 0.0) -> np.ndarray:
    out = np.full(shape, fill)
    out[rows["row"], rows["col"]] = rows[value]
    return out


CANDIDATE_SCHEMA = "candidate_id int, u double, v double, area int, mean_residual double, max_residual double, polarity string, eccentricity double, compactness double, ringness double, radius double, x0 int, y0 int, x1 int, y1 int"


_ARROW = [{"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in CANDIDATE_SCHEMA.split(", ")]


def _frames(batches: Iterator[pa.RecordBatch], keys: Sequence[str], names: Sequence[str]) -> Iterator[tuple[list[pa.Field], tuple, dict[str, np.ndarray]]]:
    """(fields of keys, key, arrays by name) of each run of rows with equal keys, however batches cut it."""
    last, parts, fields = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        fields = [batch.schema.field(k) for k in keys]
        of = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        values = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        starts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
        for a, b in zip(starts, starts[1:]):
            if parts and of[a] != last:
                yield fields, last, {n: np.concatenate([p[n] for p in parts]) for n in names}
                parts = []
            last = of[a]
            parts.append({n: v[a:b] for n, v in values.items()})
    if parts:
        yield fields, last, {n: np.concatenate([p[n] for p in parts]) for n in names}


def _table(found: list[dict], of: list[tuple], keys: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(keys, k)) | f for k, f in zip(of, found)], schema)


def detect_candidates(pixels: DataFrame, keys: Sequence[str], width: int, height: int, least: float = 4.0, percentile: float = 98.8, close: int = 3, grow: int = 1, areas: tuple[int, int] = (4, 1800), aspect: float = 10.0) -> DataFrame:
    """Moving spots of each frame of residuals (keys, row, col, absolute, signed), missing pixels 0.

    Pixels at or above the greater of least and the frame's percentile are closed, grown, and parted into
    components of eight neighbours; those within the area and aspect limits are measured and numbered.
    """
    kinds = dict(pixels.dtypes)
    names = [c.split()[0] for c in CANDIDATE_SCHEMA.split(", ")]

    def spotted(rows: dict[str, np.ndarray]) -> list[dict]:
        size, signed = np.zeros((height, width)), np.zeros((height, width))
        size[rows["row"], rows["col"]], signed[rows["row"], rows["col"]] = rows["absolute"], rows["signed"]
        spots = size >= max(least, np.percentile(size, percentile))
        if close > 1:
            spots = square(square(spots, close, True), close, False)
        for _ in range(grow):
            spots = square(spots, 3, True)
        parts, found = label(spots), []
        order = np.argsort(parts, axis=None, kind="stable")
        ends = np.cumsum(np.bincount(parts.ravel()))
        for n in range(1, len(ends)):
            y, x = np.divmod(order[ends[n - 1] : ends[n]], width)
            x0, y0, x1, y1 = int(x.min()), int(y.min()), int(x.max()), int(y.max())
            w, h = x1 - x0 + 1, y1 - y0 + 1
            if areas[0] <= len(y) <= areas[1] and max(w / h, h / w) <= aspect:
                at = slice(y0, y1 + 1), slice(x0, x1 + 1)
                found.append({"candidate_id": len(found), **_shape(parts[at] == n, size[at], signed[at], y0, x0), "x0": x0, "y0": y0, "x1": x1, "y1": y1})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, out = [], [], None
        for fields, key, rows in _frames(batches, keys, ("row", "col", "absolute", "signed")):
            out = out or pa.schema([*fields, *(pa.field(n, t) for n, t in zip(names, _ARROW))])
            found = spotted(rows)
            held += found
            of += [key] * len(found)
            if len(held) >= 5_000:
                yield _table(held, of, keys, out)
                held, of = [], []
        if held:
            yield _table(held, of, keys, out)

    dealt = pixels.select(*keys, "row", "col", "absolute", "signed").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + CANDIDATE_SCHEMA)


def ranked_components(labelled: DataFrame, keys: Sequence[str], ambiguous_from: float = 0.8) -> DataFrame:
    """Components (keys, component) of pixels with a probability, by falling mass, area and number; and how many rival the first."""
    sums = labelled.groupBy(*keys, "component").agg(F.sum("probability").alias("mass"), F.count("*").alias("area"))
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc("mass"), F.desc("area"), "component")
    ranked = sums.withColumn("rank", F.row_number().over(order)).withColumn("_top", F.max("mass").over(w))
    return ranked.withColumn("rivals", F.count_if((F.col("rank") > 1) & (F.col("mass") >= ambiguous_from * F.col("_top"))).over(w)).drop("_top")


def spread_points(core: np.ndarray, inside: np.ndarray, probability: np.ndarray, n: int, spacing: float) -> list[tuple[int, int, float]]:
    """Up to n pixels (x, y, distance inside): the deepest first, then always the one farthest from those chosen.

    Ties go to the deeper, the likelier, the upper and the left one; pixels nearer than spacing are passed over.
    """
    ys, xs = np.nonzero(core)
    chosen: list[tuple[int, int, float]] = []
    gap = np.zeros(len(xs))
    while len(xs) and len(chosen) < n:
        free = gap >= spacing if chosen else np.ones(len(xs), bool)
        if not free.any():
            break
        i = np.flatnonzero(free)
        best = i[np.lexsort((xs[i], ys[i], -probability[ys[i], xs[i]], -inside[ys[i], xs[i]], -gap[i]))[0]]
        d = np.hypot(xs - xs[best], ys - ys[best])
        gap = np.minimum(gap, d) if chosen else d
        gap[best] = -1.0
        chosen.append((int(xs[best]), int(ys[best]), float(inside[ys[best], xs[best]])))
    return chosen


def octant_points(water: np.ndarray, unknown: np.ndarray, part: np.ndarray, probability: np.ndarray, n: int, ring: tuple[float, float]) -> list[tuple[int, int, int]]:
    """Up to n known dry pixels (x, y, octant) in a ring about a part: one for each direction first, then the best of the rest.

    Better is nearer to the ring's middle, then less likely water, then upper, then left. Holes of the part aren't outside.
    """
    outside = ~part
    parts = label(outside)
    border = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    away = distance_inside(outside)
    use = outside & np.isin(parts, border[border > 0]) & ~water & ~unknown & (away >= ring[0]) & (away <= ring[1])
    ys, xs = np.nonzero(use)
    py, px = np.nonzero(part)
    angle = (np.arctan2(ys - py.mean(), xs - px.mean()) + 2 * np.pi) % (2 * np.pi)
    octant = np.floor(angle / (np.pi / 4)).astype(int) % 8
    order = np.lexsort((xs, ys, probability[ys, xs], np.abs(away[ys, xs] - sum(ring) / 2)))
    _, first = np.unique(octant[order], return_index=True)
    lead = order[first]
    rest = order[~np.isin(order, lead)]
    return [(int(xs[i]), int(ys[i]), int(octant[i])) for i in [*lead, *rest][:n]]


PROMPT_SCHEMA = "status string, reasons array<string>, box array<int>, positive array<array<int>>, negative array<array<int>>"


def prompts(pixels: DataFrame, keys: Sequence[str], width: int, height: int, margin: int = 12, least_area: int = 16, positives: tuple[int, int] = (3, 5), negatives: tuple[int, int] = (6, 8), boundary: float = 3.0, spacing: float = 10.0, ring: tuple[float, float] = (4.0, 30.0), octants: int = 4, least_probability: float = 0.0) -> DataFrame:
    """Box and points for the heaviest water part of each frame (keys, row, col, probability, state), and a gate on them.

    No water or too small a part rejects; too few points or directions make a prompt diagnostic only.
    """
    kinds = dict(pixels.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = _image(rows, "probability", (height, width))
        state = np.full((height, width), "dry", object)
        state[rows["row"], rows["col"]] = rows["state"]
        water, unknown = state == "water", state == "unknown"
        parts = label(water)
        out = {k: rows[k].iloc[0] for k in keys} | {"status": "reject", "reasons": ["no_water"], "box": None, "positive": [], "negative": []}
        if parts.max():
            number = np.arange(1, parts.max() + 1)
            mass, area = np.bincount(parts.ravel(), p.ravel())[1:], np.bincount(parts.ravel())[1:]
            part = parts == number[np.lexsort((number, -area, -mass))[0]]
            y, x = np.nonzero(part)
            inside = distance_inside(part)
            good = spread_points(part & (inside >= boundary) & (p >= least_probability), inside, p, positives[1], spacing)
            bad = octant_points(water, unknown, part, p, negatives[1], ring)
            hard = ["component_too_small"] * (len(y) < least_area)
            soft = ["too_few_positive_points"] * (len(good) < positives[0]) + ["too_few_negative_points"] * (len(bad) < negatives[0]) + ["too_few_directions"] * (len({o for _, _, o in bad}) < octants)
            out |= {"status": "reject" if hard else "diagnostic_only" if soft else "pass", "reasons": hard + soft, "positive": [[a, b] for a, b, _ in good], "negative": [[a, b] for a, b, _ in bad]}
            out["box"] = [max(0, int(x.min()) - margin), max(0, int(y.min()) - margin), min(width - 1, int(x.max()) + margin), min(height - 1, int(y.max()) + margin)]
        return pd.DataFrame([out])

    return pixels.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PROMPT_SCHEMA)


def shorelines(masks: DataFrame, keys: Sequence[str], width: int, height: int, points: int = 128) -> DataFrame:
    """points of equal arc length around the largest part of each mask (keys, row, col): (keys, n, x, y)."""
    kinds = dict(masks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        mask[rows["row"], rows["col"]] = True
        parts = label(mask)
        line = resampled(contour(parts == 1 + np.bincount(parts.ravel())[1:].argmax()), points)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "n": np.arange(points), "x": line[:, 0], "y": line[:, 1]})

    return masks.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n int, x double, y double")


def seed_pixels(mask: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """n pixels of each mask, evenly spaced in order of row and col, the first and last among them."""
    w = Window.partitionBy(*keys)
    ranked = mask.withColumn("_r", F.row_number().over(w.orderBy("row", "col")) - 1).withColumn("_n", F.count("*").over(w))
    # the k-th pick is the whole part of k * (count - 1) / (picks - 1)
    picks = F.least(F.lit(n), F.col("_n"))
    spaced = F.transform(F.sequence(F.lit(0), picks - 1), lambda k: F.floor(F.when(picks > 1, k * (F.col("_n") - 1) / (picks - 1)).otherwise(0.0)))
    return ranked.where(F.array_contains(spaced, F.col("_r").cast("long"))).drop("_r", "_n")


def reprojected(cells: DataFrame, camera: Camera, size: float, level: Column) -> DataFrame:
    """Pixels (row, col) whose centres lie in the image of a wet cell's square at water level; cells need x and y.

    A cell touches few pixels: those of its bounding box that its four edges enclose. Cells that reach behind
    the camera give none.
    """
    corners = [camera.project(F.col("x") + sx * size / 2, F.col("y") + sy * size / 2, level) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    named = cells.select(*(c.alias(f"{n}{i}") for i, (u, v, _) in enumerate(corners) for n, c in (("u", u), ("v", v)))).dropna()
    low, high = (lambda n: F.least(*(F.col(f"{n}{i}") for i in range(4)))), (lambda n: F.greatest(*(F.col(f"{n}{i}") for i in range(4))))
    span = lambda n, size: (F.greatest(F.lit(0), F.floor(low(n)).cast("int")), F.least(F.lit(size - 1), F.ceil(high(n)).cast("int")))
    (c0, c1), (r0, r1) = span("u", camera.width), span("v", camera.height)
    seen = named.where((c0 <= c1) & (r0 <= r1)).withColumn("col", F.explode(F.sequence(c0, c1))).withColumn("row", F.explode(F.sequence(r0, r1)))
    sides = []
    for i in range(4):
        j = (i + 1) % 4
        sides.append((F.col(f"u{j}") - F.col(f"u{i}")) * (F.col("row") - F.col(f"v{i}")) - (F.col(f"v{j}") - F.col(f"v{i}")) * (F.col("col") - F.col(f"u{i}")))
    return seen.where((F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)).select("row", "col").distinct()


def shift_between(masks: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Translation of mask b against mask a (keys, row, col, a, b) by phase correlation: (keys, dx, dy, response)."""
    kinds = dict(masks.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.fft.fft2(_image(rows.assign(**{n: rows[n].astype(float)}), n, (height, width))) for n in "ab")
        cross = np.conj(a) * b
        power = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        dy, dx = np.unravel_index(power.argmax(), power.shape)
        wrap = lambda d, n: int(d) - n if d > n // 2 else int(d)
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "dx": wrap(dx, width), "dy": wrap(dy, height), "response": float(power.max())}])

    return masks.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", dx int, dy int, response double")
