"""Candidates, tracks and events: association, features, matching, rules, a small model and evidence maps."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.exprs import clip, ratio_or_zero
from fluvial.operators.evidence import TILE, kernel_tiles
from fluvial.operators.joins import near_pairs
from fluvial.sources.checkpoints import cut

#: Columns of a candidate besides its sequence.
CANDIDATE = ("frame", "candidate_id", "u", "v", "area", "radius", "x0", "y0", "x1", "y1")
BOX = CANDIDATE[-4:]


def box_iou(a: Sequence[float], b: Sequence[float]) -> float:
    """IoU of two pixel boxes, ends included."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    both = max(0, w) * max(0, h)
    size = lambda r: max(0, r[2] - r[0] + 1) * max(0, r[3] - r[1] + 1)
    return both / max(1, size(a) + size(b) - both)


class OpenTracks:
    """State of one sequence's association: the last candidate of each track that may still go on."""

    def __init__(self, max_gap: int = 2, max_distance: float = 18.0, min_iou: float = 0.1):
        self.max_gap, self.max_distance, self.min_iou = max_gap, max_distance, min_iou
        self.last: dict[int, dict] = {}
        self.count = 0

    def step(self, frame: int, candidates: list[dict]) -> list[int]:
        """Track numbers of a frame's candidates, in order of falling area and then id: each takes the cheapest open track."""
        self.last = {t: c for t, c in self.last.items() if frame - c["frame"] <= self.max_gap + 1}
        free, chosen = dict(self.last), {}
        for c in sorted(candidates, key=lambda c: (-c["area"], c["candidate_id"])):
            best = None
            for t, p in free.items():
                distance = math.hypot(c["u"] - p["u"], c["v"] - p["v"])
                overlap = box_iou([c[k] for k in BOX], [p[k] for k in BOX])
                if distance <= self.max_distance + (c["radius"] + p["radius"]) / 2 or overlap >= self.min_iou:
                    cost = (distance - 8.0 * overlap + 1.5 * abs(math.log(max(c["area"], 1) / max(p["area"], 1))), t)
                    best = cost if best is None or cost < best else best
            if best:
                track = best[1]
                del free[track]
            else:
                track, self.count = self.count, self.count + 1
            chosen[c["candidate_id"]] = track
            self.last[track] = c
        return [chosen[c["candidate_id"]] for c in candidates]


def plain_row(row: dict) -> dict:
    """row with missing numbers as NaN."""
    return {k: math.nan if v is None else v for k, v in row.items()} if None in row.values() else row


def associate(candidates: DataFrame, sequence: str, **options) -> DataFrame:
    """candidates with track: association is sequential within a sequence and parallel across them.

    A task reads its sequences in order of frame and holds one frame and its open tracks, however long a sequence is.
    Candidates without a frame are left out.
    """
    schema = candidates.select(sequence, *CANDIDATE)
    dealt = schema.where(F.col("frame").isNotNull()).repartition(sequence).sortWithinPartitions(sequence, "frame", "candidate_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            nonlocal out
            for batch in batches:
                out = out or pa.schema([*batch.schema, pa.field("track", pa.int32())])
                yield from batch.to_pylist()

        out, held = None, []
        for _, own in itertools.groupby(rows(), key=lambda r: r[sequence]):
            state = OpenTracks(**options)
            for frame, together in itertools.groupby(own, key=lambda r: r["frame"]):
                together = list(together)
                for r, t in zip(together, state.step(int(frame), [plain_row(r) for r in together])):
                    held.append(r | {"track": t})
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, out)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    fields = ", ".join(f"`{n}` {t}" for n, t in schema.dtypes)
    return dealt.mapInArrow(run, f"{fields}, track int")


def track_features(observations: DataFrame, keys: Sequence[str], order: str, area: str, radius: str, intensity: str, polarity: str) -> DataFrame:
    """One row a track: duration, peak, slopes, decay, persistence, monotonicity, polarity switches, energy and asymmetry.

    Observations are numbered in order within the track; slopes are per observation. The peak is the first
    greatest intensity.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    rows = observations.withColumn("_i", (F.row_number().over(w) - 1).cast("double")).withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_peak", F.max_by(F.col("_i"), F.struct(F.col(intensity), -F.col("_i"))).over(whole)).withColumn("_after", F.when(F.col("_i") >= F.col("_peak"), F.col("_i")))
    rows = rows.withColumns({"_dr": F.col(radius) - F.lag(radius).over(w), "_switch": (F.col(polarity) != F.lag(polarity).over(w)).cast("int")})
    y = F.col(intensity).cast("double")
    slope = lambda c, x="_i": F.coalesce(F.regr_slope(F.col(c).cast("double"), F.col(x)), F.lit(0.0))
    early = F.when(F.col("_i") < F.greatest(F.lit(2), F.least(F.lit(5), F.col("_n"))), F.col("_i"))
    before, after = F.sum(F.when(F.col("_i") <= F.col("_peak"), y)), F.coalesce(F.sum(F.when(F.col("_i") > F.col("_peak"), y)), F.lit(0.0))
    return rows.withColumn("_early", early).groupBy(*keys).agg(
        (F.max(order) - F.min(order) + 1).alias("duration_frames"),
        F.count("*").alias("observations"),
        F.max("_peak").cast("int").alias("peak_offset"),
        F.max(area).alias("maximum_area"),
        slope(area).alias("area_growth_slope"),
        slope(radius).alias("radius_growth_slope"),
        slope(radius, "_early").alias("early_radius_growth_slope"),
        F.coalesce(F.avg((F.col("_dr") >= -0.05).cast("double")), F.lit(0.0)).alias("expansion_monotonicity"),
        F.greatest(F.lit(0.0), -slope(intensity, "_after") / F.greatest(F.max(y), F.lit(1e-6))).alias("decay_rate"),
        ((F.count("*") - F.max("_peak") - 1) / F.greatest(F.lit(1), F.count("*") - 1)).alias("post_peak_persistence"),
        F.coalesce(F.sum("_switch"), F.lit(0)).alias("polarity_changes"),
        ratio_or_zero(F.coalesce(F.sum("_switch"), F.lit(0)), F.greatest(F.lit(1), F.count("*") - 1)).alias("polarity_switch_rate"),
        F.sum(y * F.col(area)).alias("temporal_energy"),
        ((after - before) / F.greatest(after + before, F.lit(1e-6))).alias("temporal_asymmetry"),
    )


def neighbour_context(tracks: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, start: str, end: str, radius: float = 35.0) -> DataFrame:
    """tracks with neighbour_count within radius, and overlapping ones per frame of the track's duration."""
    pairs = near_pairs(tracks, ident, x, y, radius, keys, [start, end])
    meets = F.least(F.col(end), F.col(f"other_{end}")) - F.greatest(F.col(start), F.col(f"other_{start}")) + 1 > 0
    counts = pairs.groupBy(*keys, ident).agg(F.count("*").alias("neighbour_count"), F.count_if(meets).alias("_m"))
    return tracks.join(counts, [*keys, ident], "left").withColumn("neighbour_count", F.coalesce("neighbour_count", F.lit(0))).withColumn("local_density", F.coalesce("_m", F.lit(0)) / F.greatest(F.lit(1.0), (F.col(end) - F.col(start) + 1).cast("double"))).drop("_m")


def pair_scores(pairs: DataFrame, max_distance: float = 28.0, min_iou: float = 0.05, min_overlap: float = 0.20, min_spatial: float = 0.05) -> DataFrame:
    """Scores of overlapping track and event pairs that are near enough.

    Columns: t_start, t_end, t_u, t_v, t_x0..t_y1 of the track and e_start, e_end, e_u, e_v, e_radius of the event.
    """
    c = F.col
    both = F.greatest(F.lit(0), F.least(c("t_end"), c("e_end")) - F.greatest(c("t_start"), c("e_start")) + 1)
    dt, de = c("t_end") - c("t_start") + 1, c("e_end") - c("e_start") + 1
    nearest_u, nearest_v = F.least(F.greatest(c("e_u"), c("t_x0")), c("t_x1")), F.least(F.greatest(c("e_v"), c("t_y0")), c("t_y1"))
    rows = pairs.withColumns(
        {
            "temporal_iou": both / F.greatest(F.lit(1), dt + de - both),
            "event_overlap": both / F.greatest(F.lit(1), de),
            "center_error": F.hypot(c("t_u") - c("e_u"), c("t_v") - c("e_v")),
            "spatial_score": F.greatest(F.lit(0.0), 1 - F.hypot(nearest_u - c("e_u"), nearest_v - c("e_v")) / (F.greatest(F.lit(1.0), c("e_radius")) + max_distance * 0.5)),
            "_both": both,
        }
    )
    near = rows.where((c("_both") > 0) & (c("center_error") <= max_distance) & ((c("temporal_iou") >= min_iou) | (c("event_overlap") >= min_overlap)) & (c("spatial_score") >= min_spatial)).drop("_both")
    return near.withColumn("score", 0.30 * c("temporal_iou") + 0.25 * c("event_overlap") + 0.30 * F.greatest(F.lit(0.0), 1 - c("center_error") / max_distance) + 0.15 * c("spatial_score"))


def unambiguous(pairs: DataFrame, keys: Sequence[str], track: str, score: str, margin: float) -> DataFrame:
    """pairs with ambiguous: whether the track's two best scores are closer than margin."""
    best = pairs.groupBy(*keys, track).agg(F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2).alias("_b"))
    close = (F.size("_b") > 1) & (F.get("_b", F.lit(0)) - F.get("_b", F.lit(1)) < margin)
    return pairs.join(best.select(*keys, track, close.alias("ambiguous")), [*keys, track])


def greedy_match(pairs: DataFrame, sequence: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of each sequence: the best score first (ties: lesser left, then right), each side once."""
    small = pairs.select(sequence, left, right, score)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, kept = set(), set(), []
        ordered = group.sort_values([score, left, right], ascending=[False, True, True])
        for row in ordered.itertuples(index=False):
            a, b = getattr(row, left), getattr(row, right)
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                kept.append(row)
        return pd.DataFrame(kept, columns=ordered.columns)

    return small.groupBy(sequence).applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in small.dtypes))


def rule_classification(tracks: DataFrame, water_at: float = 0.45, dry_at: float = 0.45, margin_at: float = 0.05, least: int = 3) -> DataFrame:
    """water_ripple, dry_splash or uncertain from two weighted scores of a track's features, with a confidence.

    Needs duration_frames, observations, radius_growth_slope, post_peak_persistence, expansion_monotonicity,
    ringness, center_drift, decay_rate and compactness.
    """
    unit = lambda x: clip(x, 0.0, 1.0)
    c = F.col
    persistence = unit(c("post_peak_persistence"))
    terms = {
        "water": ((0.23, unit((c("duration_frames") - 3) / 12.0)), (0.12, unit((c("observations") - 2) / 8.0)), (0.20, unit(c("radius_growth_slope") / 0.65)), (0.16, persistence), (0.12, unit(c("expansion_monotonicity"))), (0.10, unit((c("ringness") - 0.9) / 1.5)), (0.07, 1 - unit(c("center_drift") / 12.0))),
        "dry": ((0.32, 1 - unit((c("duration_frames") - 2) / 6.0)), (0.25, 1 - unit(F.greatest(c("radius_growth_slope"), F.lit(0.0)) / 0.45)), (0.18, unit(c("decay_rate") / 0.15)), (0.15, 1 - persistence), (0.10, 1 - unit(c("compactness")))),
    }
    rows = tracks.withColumns({f"{n}_score": sum((F.lit(w) * x for w, x in ts), F.lit(0.0)) for n, ts in terms.items()})
    margin = F.abs(c("water_score") - c("dry_score"))
    label = F.when(c("observations") < least, "uncertain").when((c("water_score") >= water_at) & (c("water_score") > c("dry_score")) & (margin >= margin_at), "water_ripple").when((c("dry_score") >= dry_at) & (c("dry_score") > c("water_score")) & (margin >= margin_at), "dry_splash").otherwise("uncertain")
    return rows.withColumn("classification", label).withColumn("confidence", unit(F.greatest("water_score", "dry_score") * (0.6 + 0.4 * margin)))


def logistic_score(features: Sequence[Column], weights: Sequence[float], bias: float, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Logistic of z-scored features: missing ones count as 0, scores are kept in [-12, 12]."""
    z = F.lit(float(bias))
    for f, w, m, s in zip(features, weights, mean, std):
        x = (f.cast("double") - F.lit(float(m))) / F.lit(float(s))
        z = z + F.lit(float(w)) * clip(F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x), -12.0, 12.0)
    return 1 / (1 + F.exp(-clip(z, -40.0, 40.0)))


def probability_class(p: Column, low: float, high: float) -> Column:
    return F.when(p >= high, "water_ripple").when(p <= low, "dry_splash").otherwise("uncertain")


def hybrid_probability(model: Column, rule: Column, model_weight: float = 0.75) -> Column:
    """Blend of a model's probability of water with a rule's score, which is kept in [0, 1]; null if either is."""
    return F.lit(model_weight) * model + F.lit(1.0 - model_weight) * clip(rule, 0.0, 1.0)


def hybrid_classification(rows: DataFrame, probability: Column, low: float, high: float) -> DataFrame:
    """rows with a class by two thresholds and the confidence of the likelier side; a null probability is uncertain."""
    return rows.withColumn("classification", probability_class(probability, low, high)).withColumn("confidence", F.greatest(probability, 1 - probability))


def _gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, model: tuple) -> np.ndarray:
    """Sums of a weighted logistic loss' slopes over rows: one for each weight, then the bias."""
    coef, bias, mean, std = model
    z = np.clip(np.nan_to_num((x - mean) / std), -12, 12)
    error = (1 / (1 + np.exp(-np.clip(z @ coef + bias, -40, 40))) - y) * w
    return np.append(z.T @ error, error.sum())


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, weight: str | None = None, l2: float = 0.02, rate: float = 0.08, steps: int = 1800, most_rows: int | None = None, held: int = 100_000) -> dict:
    """Weighted full-batch gradient descent from zero weights and the prior's bias, over z-scores kept in [-12, 12].

    Every labelled row counts: equal rows become one with their weights' sum. Where at most held different ones are left, the
    driver takes the steps over them; else each step is a job whose tasks sum slopes, and the driver sees the
    sums alone. A missing feature counts as its mean. More than most_rows labelled rows are an error, if a limit is given.
    """
    features = list(features)
    labelled = rows.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).where("_y IS NOT NULL")
    equal = cut(labelled.groupBy(*features, "_y").agg(F.count("*").cast("double").alias("_n"), F.sum("_w").alias("_w")))
    size = equal.agg(F.count("*").alias("different"), F.sum("_n").alias("rows"), F.sum(F.col("_n") * F.col("_y")).alias("ones"), F.sum("_w").alias("w"), *(F.sum(F.when(F.col(f).isNotNull(), F.col("_n"))).alias(f"n_{k}") for k, f in enumerate(features)), *(F.sum(F.col(f) * F.col("_n")).alias(f"s_{k}") for k, f in enumerate(features))).first()
    if most_rows is not None and (size["rows"] or 0) > most_rows:
        raise ValueError(f"more than {most_rows} rows to fit")
    if not size["different"]:
        raise ValueError("no rows to fit")
    counts, mean = [size[f"n_{k}"] or 1.0 for k in range(len(features))], np.array([(size[f"s_{k}"] or 0.0) / (size[f"n_{k}"] or 1.0) for k in range(len(features))])
    spread = equal.agg(*(F.sum((F.col(f) - F.lit(float(m))) * (F.col(f) - F.lit(float(m))) * F.col("_n")).alias(f"v_{k}") for k, (f, m) in enumerate(zip(features, mean)))).first()
    std = np.sqrt(np.array([(v or 0.0) / n for v, n in zip(spread, counts)]))
    std[std < 1e-8] = 1.0
    names, share, whole = [*features, "_y", "_w"], size["ones"] / size["rows"], max(size["w"] or 0.0, 1e-9)
    parts = lambda t: (t[features].to_numpy(float), *(t[c].to_numpy(float) for c in ("_y", "_w")))
    near = parts(equal.select(*names).toPandas()) if size["different"] <= held else None

    def slopes(model: tuple) -> np.ndarray:
        if near is not None:
            return _gradient(*near, model)

        def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in tables:
                yield pd.DataFrame([_gradient(*parts(t), model)], columns=[f"g{k}" for k in range(len(features) + 1)])

        summed = equal.select(*names).mapInPandas(run, ", ".join(f"g{k} double" for k in range(len(features) + 1)))
        return np.array(summed.agg(*(F.sum(c) for c in summed.columns)).first(), float)

    coef, bias = np.zeros(len(features)), float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    for _ in range(steps):
        g = slopes((coef, bias, mean, std)) / whole
        coef, bias = coef - rate * (g[:-1] + l2 * coef), bias - rate * float(g[-1])
    return {"weights": coef.tolist(), "bias": bias, "mean": mean.tolist(), "std": std.tolist(), "features": features}


def sample_negatives(rows: DataFrame, keys: Sequence[str], positive: Column, order: Sequence[Column], ratio: float = 5.0, least: int = 50, most: int = 300) -> DataFrame:
    """All positive rows and the first negatives of each group: ratio times its positives, between least and most."""
    counts = rows.groupBy(*keys).agg(F.count_if(positive).alias("_p")).withColumn("_limit", F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("_p") * ratio).cast("int"))))
    joined = rows.withColumn("_pos", positive).join(counts, list(keys))
    ranked = joined.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_pos").orderBy(*order)))
    return ranked.where(F.col("_pos") | (F.col("_r") <= F.col("_limit"))).drop("_pos", "_p", "_limit", "_r")


def evidence_map(tracks: DataFrame, width: int, height: int, least_sigma: float = 4.0, reach: float = 22.0, scale: float = 1.6, water_at: float = 0.30, unknown_below: float = 0.08) -> DataFrame:
    """Pixels near water tracks with evidence, supporting tracks, probability and state: water, unknown or dry.

    tracks: u, v, maximum_area, confidence, duration_frames. Each track spreads a Gaussian over the pixels in
    its reach alone, summed tile by tile; pixels that none reaches are unknown and have no row.
    """
    weight = F.col("confidence") * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("duration_frames") / 15.0))
    tiles = kernel_tiles(tracks, [], {"evidence": weight}, width, height, least_sigma, reach)
    each = tiles.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)))).where(F.get("reached", F.col("_i")) > 0)
    summed = each.select((F.col("tx") * TILE + F.col("_i") % TILE).alias("x"), (F.col("ty") * TILE + F.floor(F.col("_i") / TILE)).cast("int").alias("y"), F.get("evidence", F.col("_i")).alias("evidence"), F.get("support", F.col("_i")).cast("long").alias("support"))
    p = 1 - F.exp(-F.col("evidence") / scale)
    return summed.withColumn("probability", p).withColumn("state", F.when(F.col("support") < unknown_below, "unknown").when(F.col("probability") >= water_at, "water").otherwise("dry"))
