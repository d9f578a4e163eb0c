"""The shadow chain: canonical states, what later stages would do with them, and validators that give reasons in place of errors.

A state is a row of sample, frame, and the columns of `water_state`. Nothing here is ever for downstream use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import reasons
from fluvial.operators.gates import monitor

#: Measurements that the stage of areas and volumes can't do without.
REQUIRED = ("mean_depth_cm", "max_depth_cm", "water_area_m2", "water_volume_m3")
MEASURES = ("estimated_water_level_m", "mean_depth_cm", "median_depth_cm", "max_depth_cm", "water_area_m2", "water_volume_m3")
STATE = ("global_estimate_status", "observable_region_result_valid", "result_semantics", "area_volume_semantics", "measurement_status", "measurements", "quality", "provenance", "authoritative", "eligible_for_downstream")


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def water_state(rows: DataFrame, sample: str, frame: str, measures: dict[str, Column], available: Column, candidate: Column, scope: Column, legacy: Column, source: Column) -> DataFrame:
    """sample, frame and the state of each row.

    available: whether geometry gave anything; candidate and legacy: pass or reject of two gates; scope:
    complete, partial or unavailable for the whole scene. Null statuses are reject and unavailable.
    Measurements that aren't finite are null, and all are without geometry; those absent from measures too.
    """
    available = F.coalesce(available, F.lit(False))
    candidate, legacy, scope = F.coalesce(candidate, F.lit("reject")), F.coalesce(legacy, F.lit("reject")), F.coalesce(scope, F.lit("unavailable"))
    valid = available & (candidate == "pass")
    by = lambda complete, partial: F.when(~valid, "unavailable").when(scope == "complete", complete).when(scope == "partial", partial).otherwise("unavailable")
    values = F.struct(*(F.when(available, _finite(measures[m]) if m in measures else F.lit(None).cast("double")).alias(m) for m in MEASURES))
    return rows.select(
        F.col(sample).alias("sample"), F.col(frame).cast("long").alias("frame"),
        F.when(valid, scope).otherwise("unavailable").alias("global_estimate_status"), valid.alias("observable_region_result_valid"),
        by("global_scene_estimate", "camera_visible_estimate").alias("result_semantics"), by("complete_estimate", "observable_lower_bound").alias("area_volume_semantics"),
        F.when(~valid & available, "rejected_candidate").otherwise(by("complete_estimate", "camera_visible_estimate")).alias("measurement_status"), values.alias("measurements"),
        F.struct(F.lit("shadow").alias("deployment_mode"), candidate.alias("candidate_status"), legacy.alias("legacy_status"), (candidate != legacy).alias("disagreement")).alias("quality"),
        F.struct(source.cast("string").alias("source"), F.lit(False).alias("ground_truth_used")).alias("provenance"),
        F.lit(False).alias("authoritative"), F.lit(False).alias("eligible_for_downstream"),
    )


def _not_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def state_fault(s: str | None = None) -> Column:
    """First reason why a state (columns of the row, or the struct s) breaks its contract; null if none. A null flag isn't false."""
    c = lambda n: F.col(f"{s}.{n}" if s else n)
    partial = c("global_estimate_status") == "partial"
    other = lambda n, want: F.coalesce(c(n) != want, F.lit(True))
    return (
        F.when(_not_false(c("eligible_for_downstream")) | _not_false(c("authoritative")), "authoritative_or_downstream_eligible")
        .when(other("quality.deployment_mode", "shadow"), "not_in_shadow_mode")
        .when(_not_false(c("provenance.ground_truth_used")), "ground_truth_provenance")
        .when(partial & other("result_semantics", "camera_visible_estimate"), "partial_result_claims_other_semantics")
        .when(partial & other("area_volume_semantics", "observable_lower_bound"), "partial_area_is_no_lower_bound")
        .when(~F.coalesce(c("observable_region_result_valid"), F.lit(False)) & other("result_semantics", "unavailable"), "invalid_result_exposes_semantics")
    )


def checked_states(states: DataFrame) -> DataFrame:
    """states as they are; one that breaks its contract is an error when it is read."""
    fault = state_fault()
    return states.withColumn("authoritative", F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("state: "), fault)).cast("boolean")).otherwise(F.col("authoritative")))


def s5_input(states: DataFrame) -> DataFrame:
    """What the stage of areas and volumes would read of each state: its measurements if it is valid and none of REQUIRED is missing."""
    there = F.col("observable_region_result_valid")
    for m in REQUIRED:
        there = there & F.col(f"measurements.{m}").isNotNull()
    values = (F.when(there, F.col(f"measurements.{m}")).alias(m) for m in MEASURES[1:])
    return states.select("sample", "frame", F.when(there, "compatible_candidate").otherwise("blocked").alias("status"), "measurement_status", "result_semantics", "area_volume_semantics", *values, F.lit(False).alias("eligible_for_s6_s8"))


def s7_preflight(states: DataFrame, fps: float, minimum_minutes: float) -> DataFrame:
    """One row a sample: whether its states are history enough for a forecast, which is never run, and why not.

    History lasts from the first to the last frame, and all states must be valid. Sums alone meet, so a
    sample of any length is one small group.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    seen = states.groupBy("sample").agg(F.count("*").alias("frames"), F.count_if("observable_region_result_valid").alias("valid_frames"), ((F.max("frame") - F.min("frame")) / F.lit(fps) / 60.0).alias("history_minutes"))
    short, spoilt = F.col("history_minutes") < minimum_minutes, F.col("valid_frames") != F.col("frames")
    why = reasons([("insufficient_canonical_history_duration", short), ("canonical_history_contains_rejected_frames", spoilt), ("shadow_mode_forecast_execution_disabled", F.lit(True))])
    return seen.select("*", (~short & ~spoilt).alias("history_ready"), F.when(~short & ~spoilt, "ready_but_disabled").otherwise("not_ready").alias("status"), why.alias("reasons"))


def s8_decision(latest: DataFrame, preflight: DataFrame) -> DataFrame:
    """One row a sample: the warning is suppressed, with its reasons after those of the history (history_reasons)."""
    joined = latest.join(preflight.select("sample", "history_ready", F.col("reasons").alias("history_reasons")), "sample", "left")
    why = reasons([
        ("phase2d_c9b_shadow_mode_warning_suppressed", F.lit(True)), ("canonical_measurement_rejected", ~F.col("observable_region_result_valid")),
        ("global_scene_estimate_partial", F.col("global_estimate_status") == "partial"), ("s7_history_not_ready", ~F.coalesce("history_ready", F.lit(False))),
    ])
    return joined.select("sample", F.lit("warning_suppressed").alias("status"), F.lit(False).alias("warning_generation_allowed"), F.lit(None).cast("string").alias("overall_warning_level"), why.alias("reasons"), "history_reasons")


def latest_states(states: DataFrame) -> DataFrame:
    """The state of each sample's last frame; of several there, the greatest by value."""
    top = F.max_by(F.struct(*(c for c in states.columns if c != "sample")), F.struct("frame", F.struct(*STATE)))
    return states.groupBy("sample").agg(top.alias("_s")).select("sample", "_s.*")


def enveloped_states(states: DataFrame) -> DataFrame:
    """One row a sample: its latest state as the struct state, as in envelopes."""
    latest = latest_states(states)
    return latest.select("sample", F.struct(*(c for c in latest.columns if c != "sample")).alias("state"))


def envelopes(states: DataFrame, fps: float, minimum_minutes: float) -> DataFrame:
    """One row a sample: state, s5, s6, s7 and s8 as structs."""
    latest = latest_states(states)
    packed = lambda rows, name: rows.select("sample", F.struct(*(c for c in rows.columns if c != "sample")).alias(name))
    s7 = s7_preflight(states, fps, minimum_minutes)
    s6 = F.struct(F.lit("not_executed").alias("status"), F.lit(False).alias("weather_correction_applied"))
    out = packed(latest, "state").withColumn("s6", s6)
    for rows, name in ((s5_input(latest), "s5"), (s7, "s7"), (s8_decision(latest, s7), "s8")):
        out = out.join(packed(rows, name), "sample")
    return out


def api_fault(s: str = "state") -> Column:
    """Why an envelope's state must not be shown; null if it may."""
    return F.when(_not_false(F.col(f"{s}.eligible_for_downstream")), "api_refuses_downstream_state")


def api_samples(enveloped: DataFrame, monitor_authoritative: bool = False, monitor_eligible: bool = False) -> DataFrame:
    """Read-only rows of envelopes: statuses and semantics, measurements of valid ones alone, no warning, and why one is refused.

    A refused row shows its sample and reason alone. A monitor that claims authority is an error.
    """
    if monitor_authoritative is not False or monitor_eligible is not False:
        raise ValueError("the monitor claims authority")
    s, refused = (lambda n: F.col(f"state.{n}")), api_fault()
    shown = {
        "frame": s("frame"), "candidate_status": s("quality.candidate_status"), **{n: s(n) for n in STATE[:4] if n != "observable_region_result_valid"},
        "measurements": F.when(s("observable_region_result_valid"), s("measurements")), **{f"{n}_shadow_status": F.col(f"{n}.status") for n in ("s5", "s7", "s8")},
    }
    return enveloped.select("sample", *(F.when(refused.isNull(), c).alias(n) for n, c in shown.items()), F.lit(None).cast("string").alias("warning_level"), F.lit(False).alias("authoritative"), F.lit(False).alias("eligible_for_downstream"), refused.alias("refused"))


def summaries(states: DataFrame, enveloped: DataFrame, outputs_unchanged: bool = True) -> DataFrame:
    """One row: counts of states and envelopes by status, in the columns that gates.monitor reads."""
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    first = states.agg(
        F.count("*").alias("records"), F.count_distinct("sample").alias("samples"), count("quality.candidate_status", "pass").alias("candidate_pass"), count("quality.candidate_status", "reject").alias("candidate_reject"),
        count("global_estimate_status", "partial").alias("global_partial"), F.count_if(_not_false(F.col("eligible_for_downstream"))).alias("downstream_eligible"), F.count_if(_not_false(F.col("authoritative"))).alias("authoritative"),
        F.coalesce(F.max(_not_false(F.col("provenance.ground_truth_used"))), F.lit(False)).alias("ground_truth_used"),
    )
    second = enveloped.agg(F.count("*").alias("envelopes"), count("s5.status", "compatible_candidate").alias("s5_compatible"), count("s7.status", "ready_but_disabled").alias("s7_ready"), count("s8.status", "warning_suppressed").alias("s8_suppressed"), F.count_if(_not_false(F.col("s8.warning_generation_allowed"))).alias("warnings_allowed"))
    return first.crossJoin(second).withColumns({"outputs_unchanged": F.lit(outputs_unchanged), "formal_executed": F.lit(False)})  # one row each


def end_to_end(total: DataFrame, api: DataFrame, expected: DataFrame, audited: DataFrame, settings: dict[str, bool]) -> DataFrame:
    """(name, passed) of nineteen named invariants of a run; what is null has failed.

    total: summaries. expected: one row of records, samples, candidate_pass, candidate_reject and
    global_partial. audited: rows of the audit with sample. settings: audit_db_unchanged, http_server_started,
    agent_executed, warning_generated, api_read_only, warning_actions.
    """
    c, want = F.col, (lambda n: F.col(f"want_{n}"))
    hidden = api.agg(F.coalesce(F.min((c("candidate_status") != "reject") | c("measurements").isNull()), F.lit(True)).alias("hidden"))
    row = monitor(total).crossJoin(expected.select(*(c(n).alias(f"want_{n}") for n in expected.columns))).crossJoin(hidden).crossJoin(audited.agg(F.count_distinct("sample").alias("audited")))  # one row each
    flag = lambda n: F.lit(settings.get(n))
    named = [
        ("canonical_record_count", c("records") == want("records")), ("canonical_sample_count", c("samples") == want("samples")), ("candidate_pass_count", c("candidate_pass") == want("candidate_pass")),
        ("candidate_reject_count", c("candidate_reject") == want("candidate_reject")), ("global_partial_count", c("global_partial") == want("global_partial")), ("canonical_all_blocked", (c("downstream_eligible") == 0) & (c("authoritative") == 0)),
        ("canonical_prediction_only", ~c("ground_truth_used")), ("shadow_envelope_count", c("envelopes") == want("samples")), ("s8_all_suppressed", c("s8_suppressed") == want("samples")), ("warning_allowed_zero", c("warnings_allowed") == 0),
        ("formal_s5_s8_hashes_unchanged", c("outputs_unchanged")), ("monitor_healthy", c("monitor_status") == "healthy"), ("formal_audit_db_unchanged", flag("audit_db_unchanged")), ("http_server_not_started", ~flag("http_server_started").cast("boolean")),
        ("formal_agent_not_executed", ~flag("agent_executed").cast("boolean")), ("formal_warning_not_generated", ~flag("warning_generated").cast("boolean")), ("api_read_only", flag("api_read_only").cast("boolean") & ~flag("warning_actions").cast("boolean")),
        ("api_rejected_measurements_hidden", c("hidden")), ("sidecar_audit_sample_count", c("audited") == want("samples")),
    ]
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(x.cast("boolean"), F.lit(False)).alias("passed")) for n, x in named))
    return row.select(F.explode(listed).alias("_c")).select("_c.*")


#: Faults that a record is copied with, and the validator that must reject it.
FAULTS = {
    "missing_required_json": "document", "corrupted_json": "document", "ground_truth_leakage": "state", "downstream_enabled_in_shadow": "state", "partial_result_claims_global_semantics": "state",
    "warning_generation_enabled": "monitor", "api_exposes_downstream_state": "api", "sidecar_database_authoritative_constraint": "audit", "formal_hash_mismatch": "hashes",
}


def injected(enveloped: DataFrame) -> DataFrame:
    """Every envelope once as it is (scenario none) and once with each of FAULTS, as JSON text of its document."""
    spread = enveloped.withColumn("scenario", F.explode(F.array(F.lit("none"), *map(F.lit, FAULTS))))
    at = lambda *names: F.col("scenario").isin(*names)
    state = F.col("state")
    partial, downstream = at("partial_result_claims_global_semantics"), at("downstream_enabled_in_shadow", "api_exposes_downstream_state")
    changes = {
        "provenance.ground_truth_used": (at("ground_truth_leakage"), F.lit(True)), "eligible_for_downstream": (downstream, F.lit(True)), "global_estimate_status": (partial, F.lit("partial")),
        "observable_region_result_valid": (partial, F.lit(True)), "result_semantics": (partial, F.lit("global_scene_estimate")), "area_volume_semantics": (partial, F.lit("complete_estimate")),
    }
    for name, (when, value) in changes.items():
        state = state.withField(name, F.when(when, value).otherwise(F.col(f"state.{name}")))
    summary = F.struct(
        F.lit(0).alias("downstream_eligible"), F.lit(0).alias("authoritative"), F.when(at("warning_generation_enabled"), 1).otherwise(0).alias("warnings_allowed"),
        F.lit(True).alias("outputs_unchanged"), F.lit(False).alias("formal_executed"), F.lit(False).alias("ground_truth_used"),
    )
    audit = F.struct(F.when(at("sidecar_database_authoritative_constraint"), 1).otherwise(0).alias("authoritative"), F.lit(0).alias("eligible_for_downstream"), F.lit(0).alias("formal_warning_generated"))
    digest = F.sha2(F.to_json("state"), 256)
    hashes = F.struct(digest.alias("before"), F.when(at("formal_hash_mismatch"), F.reverse(digest)).otherwise(digest).alias("after"))
    text = F.to_json(F.struct(state.alias("state"), summary.alias("summary"), audit.alias("audit"), hashes.alias("hashes")), {"ignoreNullFields": "false"})
    broken = F.when(at("corrupted_json"), F.expr("substring(_text, 1, length(_text) div 2)")).when(at("missing_required_json"), F.lit(None).cast("string")).otherwise(F.col("_text"))
    return spread.withColumn("_text", text).select("sample", "scenario", broken.alias("text"))


def validated(documents: DataFrame, state_type: str) -> DataFrame:
    """documents (text: JSON of state, summary, audit and hashes) with the reason of each validator: document, state, monitor, api, audit, hashes; null is passed.

    Text that isn't there or isn't JSON of that form fails as a document, and nothing else is said of it.
    """
    flags = "downstream_eligible int, authoritative int, warnings_allowed int, outputs_unchanged boolean, formal_executed boolean, ground_truth_used boolean"
    schema = f"state {state_type}, summary struct<{flags}>, audit struct<authoritative: int, eligible_for_downstream: int, formal_warning_generated: int>, hashes struct<before: string, after: string>, _corrupt string"
    parsed = documents.withColumn("_d", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})).select(*documents.columns, "_d.*")
    document = F.when(F.col("text").isNull(), "missing").when(F.col("_corrupt").isNotNull() | F.col("state").isNull(), "corrupt")
    watched = monitor(parsed.select("*", *(F.col(f"summary.{f.split()[0]}") for f in flags.split(", "))))
    clean = lambda n: F.coalesce(F.col(f"audit.{n}") == 0, F.lit(False))
    found = {
        "state": state_fault("state"), "monitor": F.when(F.col("monitor_status") == "unsafe", "unsafe"), "api": api_fault("state"),
        "audit": F.when(~(clean("authoritative") & clean("eligible_for_downstream") & clean("formal_warning_generated")), "constraint"),
        "hashes": F.when(~F.coalesce(F.col("hashes.before") == F.col("hashes.after"), F.lit(False)), "hash_mismatch"),
    }
    return watched.select(*documents.columns, document.alias("document"), *(F.when(document.isNull(), c).alias(n) for n, c in found.items()))


def fault_suite(enveloped: DataFrame) -> DataFrame:
    """sample, scenario, validator, reason and rejected, for each envelope and each fault; scenario none must pass all validators.

    Of an envelope only sample and state are read, so rows of these alone do.
    """
    kind = dict(enveloped.dtypes)["state"]
    rows = validated(injected(enveloped), kind)
    names: Sequence[str] = list(dict.fromkeys(FAULTS.values()))
    by = F.create_map(*(x for k, v in FAULTS.items() for x in (F.lit(k), F.lit(v))))
    reason = F.coalesce(*(F.when(F.try_element_at(by, F.col("scenario")) == n, F.col(n)) for n in names), F.when(F.col("scenario") == "none", F.coalesce(*names)))
    return rows.select("sample", "scenario", F.try_element_at(by, F.col("scenario")).alias("validator"), reason.alias("reason"), reason.isNotNull().alias("rejected"))
