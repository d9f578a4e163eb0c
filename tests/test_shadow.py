"""The shadow chain by hand: semantics, order of reasons, faults and invariants."""

import pytest
from fluvial.operators import shadow
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

RAW = "s string, f int, mean double, depth double, available boolean, candidate string, scope string"
ROWS = [
    ("a", 1, 1.0, 2.0, True, "pass", "complete"), ("a", 601, 3.0, 4.0, True, "pass", "partial"),
    ("b", 1, 5.0, 6.0, True, "pass", "complete"), ("b", 2, float("nan"), 7.0, True, "reject", "partial"),
    ("c", 9, 8.0, None, None, None, None),
]
C = F.col  # columns need a session, so they are made in tests


def states(spark, rows=ROWS):
    return shadow.water_state(spark.createDataFrame(rows, RAW), "s", "f", {"mean_depth_cm": C("mean"), "max_depth_cm": C("depth"), "water_area_m2": F.lit(1.0), "water_volume_m3": F.lit(float("inf")) * 0 + 1}, C("available"), C("candidate"), C("scope"), F.lit("pass"), F.lit("model"))


def volumes(spark, rows=ROWS):
    """States whose volume is finite."""
    s = states(spark, rows)
    return s.withColumn("measurements", C("measurements").withField("water_volume_m3", F.when(C("measurements.mean_depth_cm").isNotNull(), F.lit(1.0))))


def test_semantics(spark):
    found = {(r["sample"], r.frame): r for r in states(spark).collect()}
    assert [(found[k].global_estimate_status, found[k].result_semantics, found[k].area_volume_semantics, found[k].measurement_status) for k in sorted(found)] == [
        ("complete", "global_scene_estimate", "complete_estimate", "complete_estimate"), ("partial", "camera_visible_estimate", "observable_lower_bound", "camera_visible_estimate"),
        ("complete", "global_scene_estimate", "complete_estimate", "complete_estimate"), ("unavailable", "unavailable", "unavailable", "rejected_candidate"), ("unavailable", "unavailable", "unavailable", "unavailable"),
    ]
    assert found["b", 2].measurements.mean_depth_cm is None and found["b", 2].measurements.max_depth_cm == 7.0
    assert found["c", 9].measurements.mean_depth_cm is None  # no geometry
    assert found["a", 1].measurements.water_volume_m3 is None  # not finite
    assert states(spark).where(shadow.state_fault().isNotNull()).collect() == []


def test_the_chain(spark):
    s = volumes(spark)
    five = {(r["sample"], r.frame): (r.status, r.mean_depth_cm) for r in shadow.s5_input(s).collect()}
    assert five == {("a", 1): ("compatible_candidate", 1.0), ("a", 601): ("compatible_candidate", 3.0), ("b", 1): ("compatible_candidate", 5.0), ("b", 2): ("blocked", None), ("c", 9): ("blocked", None)}
    seven = {r["sample"]: (r.frames, r.valid_frames, r.history_minutes, r.status, r.reasons) for r in shadow.s7_preflight(s, 10.0, 1.0).collect()}
    disabled = "shadow_mode_forecast_execution_disabled"
    assert seven["a"] == (2, 2, 1.0, "ready_but_disabled", [disabled])
    assert seven["b"][3:] == ("not_ready", ["insufficient_canonical_history_duration", "canonical_history_contains_rejected_frames", disabled])
    eight = {r["sample"]: (r.status, r.reasons, r.history_reasons) for r in shadow.s8_decision(shadow.latest_states(s), shadow.s7_preflight(s, 10.0, 1.0)).collect()}
    first = "phase2d_c9b_shadow_mode_warning_suppressed"
    assert eight["a"] == ("warning_suppressed", [first, "global_scene_estimate_partial"], [disabled])
    assert eight["b"][1] == [first, "canonical_measurement_rejected", "s7_history_not_ready"]
    api = {r["sample"]: r for r in shadow.api_samples(shadow.envelopes(s, 10.0, 1.0)).collect()}
    assert api["a"].measurements.mean_depth_cm == 3.0 and api["b"].measurements is None and api["c"].refused is None
    assert (api["a"].s5_shadow_status, api["a"].s7_shadow_status, api["a"].s8_shadow_status) == ("compatible_candidate", "ready_but_disabled", "warning_suppressed")
    with pytest.raises(ValueError):
        shadow.s7_preflight(s, 0, 1.0)
    with pytest.raises(ValueError):
        shadow.api_samples(shadow.envelopes(s, 10.0, 1.0), monitor_authoritative=True)


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda: {"eligible_for_downstream": F.lit(True)}, "authoritative_or_downstream_eligible"),
        (lambda: {"authoritative": F.lit(None).cast("boolean")}, "authoritative_or_downstream_eligible"),
        (lambda: {"quality": C("quality").withField("deployment_mode", F.lit("live"))}, "not_in_shadow_mode"),
        (lambda: {"provenance": C("provenance").withField("ground_truth_used", F.lit(True))}, "ground_truth_provenance"),
        (lambda: {"global_estimate_status": F.lit("partial"), "result_semantics": F.lit("global_scene_estimate")}, "partial_result_claims_other_semantics"),
        (lambda: {"global_estimate_status": F.lit("partial"), "result_semantics": F.lit("camera_visible_estimate"), "area_volume_semantics": F.lit("complete_estimate")}, "partial_area_is_no_lower_bound"),
        (lambda: {"global_estimate_status": F.lit("complete"), "observable_region_result_valid": F.lit(False)}, "invalid_result_exposes_semantics"),
    ],
)
def test_reasons_of_the_state_validator(spark, change, reason):
    one = states(spark).where("sample = 'a' AND frame = 1").withColumns(change())
    assert one.select(shadow.state_fault().alias("r")).first().r == reason
    with pytest.raises(PySparkException, match=reason):
        shadow.checked_states(one).collect()


def test_every_fault_is_rejected_and_no_clean_record(spark):
    found = shadow.fault_suite(shadow.envelopes(volumes(spark), 10.0, 1.0)).collect()
    assert len(found) == 3 * 10
    for r in found:
        assert r.validator == shadow.FAULTS.get(r.scenario) and r.rejected == (r.scenario != "none"), r
    # a validator sees a fault that no scenario injects, too
    documents = shadow.injected(shadow.envelopes(volumes(spark), 10.0, 1.0)).where("scenario = 'none'")
    kind = dict(shadow.envelopes(volumes(spark), 10.0, 1.0).dtypes)["state"]
    bad = shadow.validated(documents.withColumn("text", F.replace("text", F.lit('"outputs_unchanged":true'), F.lit('"outputs_unchanged":null'))), kind).collect()
    assert {r.monitor for r in bad} == {"unsafe"} and {r.state for r in bad} == {None}


def test_nineteen_invariants(spark):
    s = volumes(spark)
    e = shadow.envelopes(s, 10.0, 1.0)
    expected = spark.createDataFrame([(5, 3, 3, 2, 1)], "records int, samples int, candidate_pass int, candidate_reject int, global_partial int")
    settings = {"audit_db_unchanged": True, "http_server_started": False, "agent_executed": False, "warning_generated": False, "api_read_only": True, "warning_actions": False}
    run = lambda **k: {r.name: r.passed for r in shadow.end_to_end(k.get("total", shadow.summaries(s, e)), shadow.api_samples(e), k.get("expected", expected), k.get("audited", e), k.get("settings", settings)).collect()}
    found = run()
    assert len(found) == 19 and all(found.values()), found
    assert [n for n, p in run(expected=expected.withColumn("records", F.lit(6))).items() if not p] == ["canonical_record_count"]
    assert [n for n, p in run(audited=e.limit(2)).items() if not p] == ["sidecar_audit_sample_count"]
    assert [n for n, p in run(total=shadow.summaries(s, e, False)).items() if not p] == ["formal_s5_s8_hashes_unchanged", "monitor_healthy"]
    assert [n for n, p in run(settings={**settings, "http_server_started": None}).items() if not p] == ["http_server_not_started"]
    assert [n for n, p in run(total=shadow.summaries(s.withColumn("authoritative", F.lit(True)), e)).items() if not p] == ["canonical_all_blocked", "monitor_healthy"]


def test_no_states(spark):
    none = states(spark, [])
    assert shadow.envelopes(none, 1.0, 1.0).collect() == [] and shadow.fault_suite(shadow.envelopes(none, 1.0, 1.0)).collect() == []
    assert shadow.summaries(none, shadow.envelopes(none, 1.0, 1.0)).first().records == 0


def test_faults_need_a_sample_and_its_state_alone(spark, tmp_path):
    from fluvial.plans.shadow import injected_faults

    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string"
    spark.createDataFrame([(k, 1, 1, n, 5.0, 10.0 * n, 0.1, "NAR"[k % 3]) for k in range(6) for n in (1, 2)], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = injected_faults(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    rows = found.collect()
    assert len(rows) == 60 and all(r.rejected == (r.scenario != "none") for r in rows)
