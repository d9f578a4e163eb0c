"""Quality gates: named checks on a row, collected as reasons, and a status from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import finite_or_null, reasons


@dataclass(frozen=True)
class Check:
    """A reason and when it holds; kind groups reasons into columns."""

    reason: str
    when: Column
    kind: str = "reject"


def evaluate(rows: DataFrame, checks: Sequence[Check], status: str = "status") -> DataFrame:
    """rows with one array of reasons a kind (<kind>_reasons) and a status: reject, warning or pass."""
    kinds = list(dict.fromkeys([c.kind for c in checks]))
    out = rows.withColumns({f"{k}_reasons": reasons([(c.reason, c.when) for c in checks if c.kind == k]) for k in kinds})
    hard = [k for k in kinds if k not in ("warning", "advice", "scope")]
    bad = sum((F.size(f"{k}_reasons") for k in hard), F.lit(0)) > 0
    soft = F.size("warning_reasons") > 0 if "warning" in kinds else F.lit(False)
    return out.withColumn(status, F.when(bad, "reject").when(soft, "warning").otherwise("pass"))


def _missing_or_above(c: str, limit: float) -> Column:
    x = finite_or_null(F.col(c))
    return x.isNull() | (x > limit)


def water_quality_checks(min_coverage=0.40, max_components=4, min_largest=0.80, min_samples=20, max_mad=0.025, max_iqr=0.075, max_depth=0.60) -> list[Check]:
    """Checks of an inverted water region (columns as the reasons name them)."""
    return [
        Check("camera_mask_empty", F.col("camera_pixels") <= 0),
        Check("projection_coverage_below_threshold", F.col("projection_coverage") < min_coverage),
        Check("predicted_dem_mask_empty", F.col("cells") <= 0),
        Check("component_count_out_of_range", ~F.col("component_count").between(1, max_components)),
        Check("largest_component_ratio_below_threshold", F.col("largest_component_ratio") < min_largest),
        Check("boundary_sample_count_below_threshold", F.col("boundary_samples") < min_samples),
        Check("boundary_height_mad_above_threshold", _missing_or_above("boundary_mad", max_mad)),
        Check("boundary_height_iqr_above_threshold", _missing_or_above("boundary_iqr", max_iqr)),
        Check("inner_outer_boundary_bracket_invalid", ~F.coalesce(F.col("bracket_valid"), F.lit(False))),
        Check("estimated_water_level_nonfinite", finite_or_null(F.col("level")).isNull()),
        Check("maximum_depth_exceeds_physical_limit", _missing_or_above("max_depth", max_depth)),
        Check("negative_depth_detected", F.col("negative_depths") != 0),
        Check("negative_or_missing_area", F.col("area").isNull() | (F.col("area") < 0)),
        Check("negative_or_missing_volume", F.col("volume").isNull() | (F.col("volume") < 0)),
        Check("infinite_depth_detected", F.col("infinite_depths") != 0),
    ]


def coverage_checks(ratio: str = "valid_ratio", error: str = "mean_error", known: str | None = None) -> list[Check]:
    """Coverage below 0.15 or 0.30, and mean error above 20 or 10, in magnitude; without known truth no error is asked for."""
    has = F.col(known).isNotNull() if known else F.lit(True)
    return [
        Check("missing_coverage", F.col(ratio).isNull()),
        Check("low_coverage", F.col(ratio) < 0.15),
        Check("low_coverage_warning", (F.col(ratio) >= 0.15) & (F.col(ratio) < 0.30), "warning"),
        Check("missing_mean_error", has & F.col(error).isNull()),
        Check("high_mean_error", has & (F.abs(F.col(error)) > 20.0)),
        Check("mean_error_warning", has & (F.abs(F.col(error)) > 10.0) & (F.abs(F.col(error)) <= 20.0), "warning"),
    ]


def boundary_checks(count: str = "boundary_cells", std: str = "boundary_std") -> list[Check]:
    """Fewer than 10 boundary cells, or heights that spread over more than 10 or 5 cm."""
    return [
        Check("too_few_boundary_cells", F.col(count) < 10),
        Check("boundary_std_unavailable", F.col(std).isNull()),
        Check("boundary_std_reject", F.col(std) > 10.0),
        Check("boundary_std_warning", (F.col(std) > 5.0) & (F.col(std) <= 10.0), "warning"),
    ]


def candidate_checks() -> list[Check]:
    """Frame and sequence checks of a candidate; the boundary only advises, basins out of view limit the scope."""
    low = lambda c, t: finite_or_null(F.col(c)).isNull() | (F.col(c) < t)
    return [
        Check("geometry_unavailable", ~F.coalesce(F.col("geometry_available"), F.lit(False)), "hard"),
        Check("no_selected_basin", F.col("selected_basins") < 1, "hard"),
        Check("estimated_water_level_nonfinite", finite_or_null(F.col("level")).isNull(), "hard"),
        Check("maximum_depth_nonfinite", finite_or_null(F.col("max_depth_cm")).isNull(), "hard"),
        Check("negative_depth_detected", F.col("max_depth_cm") < 0, "hard"),
        Check("maximum_depth_exceeds_physical_limit", F.col("max_depth_cm") > 60.0, "hard"),
        Check("shoreline_intersection_rate_below_candidate_threshold", F.coalesce(F.col("intersection_rate"), F.lit(0.0)) < 0.65, "visible"),
        Check("seed_ray_success_rate_below_candidate_threshold", F.coalesce(F.col("seed_rate"), F.lit(0.0)) < 0.65, "visible"),
        Check("shoreline_sample_count_below_candidate_threshold", F.col("samples") < 20, "visible"),
        Check("shoreline_height_mad_above_candidate_threshold", _missing_or_above("mad", 0.020), "visible"),
        Check("shoreline_height_iqr_above_candidate_threshold", _missing_or_above("iqr", 0.060), "visible"),
        Check("camera_reprojection_iou_below_candidate_threshold", low("camera_iou", 0.90), "visible"),
        Check("outer_boundary_reprojection_p95_unavailable", finite_or_null(F.col("boundary_p95")).isNull(), "advice"),
        Check("outer_boundary_reprojection_p95_above_advisory_threshold", F.col("boundary_p95") > 5.0, "advice"),
        Check("water_level_window_std_above_candidate_threshold", F.col("level_std_cm") > 0.50, "temporal"),
        Check("adjacent_water_level_change_p95_above_candidate_threshold", F.col("adjacent_p95_cm") > 1.00, "temporal"),
        Check("water_area_cv_above_candidate_threshold", F.col("area_cv") > 0.10, "temporal"),
        Check("water_volume_cv_above_candidate_threshold", F.col("volume_cv") > 0.20, "temporal"),
        Check("candidate_basin_outside_camera_coverage", F.col("unobserved_basins") > 0, "scope"),
        Check("ambiguous_candidate_basin", F.col("ambiguous_basins") > 0, "scope"),
    ]


def candidate_gate(frames: DataFrame) -> DataFrame:
    """candidate_checks with what the result stands for: all of the scene, its visible part, or nothing."""
    rows = evaluate(frames, candidate_checks(), "visible_status")
    scope = F.when(F.col("visible_status") == "reject", "unavailable").when(F.size("scope_reasons") > 0, "partial").otherwise("complete")
    rows = rows.withColumn("scene_status", scope)
    return rows.withColumn("semantics", F.when(F.col("scene_status") == "complete", "global_scene_estimate").when(F.col("scene_status") == "partial", "camera_visible_estimate").otherwise("unavailable"))


def joint_gate(rows: DataFrame, visual: str = "visual_status", geometry: str = "geometry_status", scope: str = "global_status", observable: str = "observable") -> DataFrame:
    """Joint status of a visual and a geometry gate, and what is measured. A null geometry status is a failure."""
    v, g, s = F.coalesce(F.col(visual), F.lit("reject")), F.col(geometry), F.col(scope)
    status = F.when(g.isNull() | (v == "reject") | (g == "reject"), "reject").when((v == "pass") & (g == "pass") & (s == "complete"), "pass").otherwise("partial")
    rows = rows.withColumn("status", status)
    measured = F.when(g.isNull(), "unavailable").when(F.col("status") == "pass", "complete_estimate").when((F.col("status") == "partial") & F.coalesce(F.col(observable), F.lit(False)), "observable_region_estimate").otherwise("rejected_candidate")
    return rows.withColumn("measurement_status", measured).withColumn("authoritative", F.col("measurement_status").isin("complete_estimate", "observable_region_estimate"))


def prefixed(arrays: dict[str, Column]) -> Column:
    """Reasons of several gates in one array, each with its gate's name before it."""

    def of(name: str, listed: Column) -> Column:
        return F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda r: F.concat(F.lit(f"{name}:"), r))

    return F.concat(*(of(n, a) for n, a in arrays.items()))


#: Words of provenance that name truth; a state must not come from such a table.
TRUTH_WORDS = ("ground_truth", "groundtruth", "_gt", "truth")


def canonical_state(rows: DataFrame, ids: Sequence[str], measures: Sequence[str], valid: Column, provenance: str, version: str = "1") -> DataFrame:
    """Nested state: identity, measurements (null unless valid), quality, provenance, never for downstream use.

    A provenance that names truth fails the query.
    """
    clean = F.when(F.lower(F.col(provenance)).rlike("|".join(TRUTH_WORDS)), F.raise_error(F.concat(F.lit("truth in provenance: "), F.col(provenance))).cast("string")).otherwise(F.col(provenance))
    return rows.select(
        *ids,
        F.struct(F.lit(version).alias("schema_version"), *ids).alias("identity"),
        F.when(valid, F.struct(*measures)).alias("measurements"),
        F.struct(valid.alias("valid"), F.lit(False).alias("authoritative"), F.lit(False).alias("eligible_for_downstream")).alias("quality"),
        F.struct(clean.alias("source")).alias("provenance"),
    )


def shadow_envelope(states: DataFrame, sample: str, frame: str, fps: float, minimum_minutes: float) -> DataFrame:
    """One row a sample: latest state's measurements if valid, minutes of history, whether they suffice, warnings off."""
    minutes = (F.max(frame) - F.min(frame)) / F.lit(fps * 60.0)
    latest = F.max_by(F.struct("measurements", F.col("quality.valid").alias("valid")), F.col(frame))
    rows = states.groupBy(sample).agg(F.count("*").alias("frames"), F.max(frame).alias("latest_frame"), minutes.alias("history_minutes"), latest.alias("_l"))
    return rows.select(sample, "frames", "latest_frame", "history_minutes", F.col("_l.valid").alias("valid"), F.when(F.col("_l.valid"), F.col("_l.measurements")).alias("measurements"), (F.col("_l.valid") & (F.col("history_minutes") >= minimum_minutes)).alias("forecast_ready"), F.lit("suppressed").alias("warning"))


def invariants(checks: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    """(name, passed) for each named condition over a one-row table; null counts as failed."""
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in named))
    return checks.select(F.explode(listed).alias("c")).select("c.*")


def monitor(summaries: DataFrame) -> DataFrame:
    """summaries with monitor_status: healthy only if six conditions hold, each of which fails where its column is null.

    Columns: downstream_eligible, authoritative, warnings_allowed (counts that must be 0), outputs_unchanged (true),
    formal_executed and ground_truth_used (false).
    """
    zero = [F.col(c) == 0 for c in ("downstream_eligible", "authoritative", "warnings_allowed")]
    safe = [F.coalesce(c, F.lit(False)) for c in (*zero, F.col("outputs_unchanged"), ~F.col("formal_executed"), ~F.col("ground_truth_used"))]
    every = safe[0]
    for c in safe[1:]:
        every = every & c
    return summaries.withColumn("monitor_status", F.when(every, "healthy").otherwise("unsafe"))


def api_view(states: DataFrame, status: Column) -> DataFrame:
    """Read-only rows of canonical states: measurements of valid ones alone, no warning level, nothing for downstream use.

    A state that claims to be eligible for downstream use fails the query.
    """
    refused = F.when(F.coalesce(F.col("quality.eligible_for_downstream"), F.lit(True)), F.raise_error(F.lit("a state eligible for downstream use")).cast("boolean")).otherwise(F.lit(False))
    ids = [c for c in states.columns if c not in ("identity", "measurements", "quality", "provenance")]
    return states.select(
        *ids,
        status.alias("candidate_status"),
        F.when(F.col("quality.valid"), F.col("measurements")).alias("measurements"),
        F.lit(None).cast("string").alias("warning_level"),
        F.lit(False).alias("authoritative"),
        refused.alias("eligible_for_downstream"),
    )


#: What fault_suite injects: a column of a summary and the value it must not have.
FAULTS = (
    ("downstream_eligible", "downstream_eligible", "1"), ("authoritative", "authoritative", "1"), ("warning_allowed", "warnings_allowed", "1"), ("downstream_missing", "downstream_eligible", None),
    ("outputs_changed", "outputs_unchanged", "false"), ("outputs_unknown", "outputs_unchanged", None), ("formal_executed", "formal_executed", "true"), ("truth_used", "ground_truth_used", "true"), ("truth_unknown", "ground_truth_used", None),
)


def fault_suite(summaries: DataFrame) -> DataFrame:
    """Each summary with each fault of FAULTS, and whether the monitor rejected it although it takes the clean one for healthy."""
    clean = monitor(summaries).withColumnRenamed("monitor_status", "_clean")
    types = dict(summaries.dtypes)
    spread = clean.withColumn("fault", F.explode(F.array(*(F.lit(n) for n, _, _ in FAULTS))))
    for column in dict.fromkeys(c for _, c, _ in FAULTS):
        value = F.col(column)
        for name, c, bad in FAULTS:
            if c == column:
                value = F.when(F.col("fault") == name, F.lit(bad).cast(types[c])).otherwise(value)
        spread = spread.withColumn(column, value)
    return monitor(spread).withColumn("rejected", (F.col("_clean") == "healthy") & (F.col("monitor_status") == "unsafe")).drop("_clean")
