"""Specs, gates and ledgers: success, boundary and failure of each."""

from __future__ import annotations

import pytest

from quernstone.functions.predicates import SpecError
from quernstone.operators import table
from quernstone.plans import control, experiments, registry

ROWS = [{"day": f"2024-01-{d:02d}", "v": str(d), "g": "a" if d % 2 else "b", "x": "7"} for d in range(1, 13)]
SOURCE = {"rows": ROWS, "time_field": "day", "granularity": "daily"}


def part(**more):
    return {"component_id": "c", "dimension": "direction", "required_granularity": "daily", "measurement": {"kind": "period_change", "field": "v"}, "expectation": {"operator": "gt", "value": 0}} | more


def run(spark, *parts):
    return experiments.run_experiment(spark, {"mode": "atomic_claims", "data_source": SOURCE, "components": list(parts)})


def test_atomic_claims(spark):
    out = run(spark, part(), part(dimension="invalidation", expectation={"operator": "lt", "value": 0}), part(dimension="point", measurement={"kind": "max", "field": "v"}, expectation={"operator": "eq", "value": 3}), part(dimension="path", required_granularity="1m"))
    by = {d: [c["status"] for c in x["components"]] for d, x in out["dimensions"].items()}
    assert by == {"direction": ["supported"], "invalidation": ["not_triggered"], "point": ["contradicted"], "path": ["unverifiable"], "time": []}
    assert out["summary"]["total_label"] is None and out["dimensions"]["time"]["coverage"] == "not_claimed"


def test_data_problems_are_results(spark):
    out = run(spark, part(measurement={"kind": "mean", "field": "g"}))
    assert out["execution_status"] == "completed" and out["summary"]["status_counts"] == {"unverifiable": 1}
    assert run(spark, part(measurement={"kind": "mode"}))["execution_status"] == "invalid_spec"
    assert experiments.run_experiment(spark, {"mode": "atomic_claims", "data_source": {"time_field": "t", "granularity": "daily"}, "components": [part()]})["execution_status"] == "invalid_spec"


def test_comparison(spark):
    spec = {
        "mode": "hypothesis_comparison", "data_source": SOURCE, "required_granularity": "daily", "measurement": {"kind": "mean", "field": "v"}, "mechanism_variable": "Unit Price", "changed_or_isolated_variable": "unit-price",
        "candidate_core_mechanism": "价格 Ｘ", "target_mechanism": "价格x", "baseline_hypothesis_id": "e0", "candidate_hypothesis_id": "e1", "candidate_id": "c", "measurement_window_claim": "w", "distinguishing_observation": "d",
        "data_evidence_refs": ["E1"],
        "hypotheses": [{"hypothesis_id": "e0", "statement": "s", "prediction": {"operator": "lt", "value": 5}}, {"hypothesis_id": "e1", "statement": "s", "prediction": {"operator": "gte", "value": 5}}],
    }
    run = lambda **changed: experiments.run_experiment(spark, spec | changed)
    assert run()["evidence_direction"] == "supports_e1" and run()["supported_hypothesis_ids"] == ["e1"]
    assert run(baseline_hypothesis_id="e1", candidate_hypothesis_id="e0")["evidence_direction"] == "supports_e0"
    assert run(changed_or_isolated_variable="other")["execution_status"] == run(target_mechanism="y")["execution_status"] == "rejected_misaligned"
    assert run(required_granularity="1m")["execution_status"] == "unverifiable"
    assert run(data_source={"path": "/nowhere/x.csv", "time_field": "t", "granularity": "daily"})["execution_status"] == "unverifiable"
    same = [h | {"prediction": spec["hypotheses"][0]["prediction"]} for h in spec["hypotheses"]]
    for wrong in ({"hypotheses": same}, {"hypotheses": same[:1]}, {"data_evidence_refs": []}, {"candidate_hypothesis_id": "e9"}, {"mode": "atomic"}, {"distinguishing_observation": " "}):
        assert run(**wrong)["execution_status"] == "invalid_spec"
    assert experiments.run_analysis(spark, spec | {"layer": "mechanism"})["evidence_direction"] == "supports_e1"


def test_analysis_layers(spark):
    b = {"segment_field": "x", "group_field": "g", "group_a": "a", "group_b": "b", "outcome_field": "v", "minimum_group_n": 2}
    out = experiments.run_analysis(spark, {"layer": "heterogeneity", "data_source": SOURCE, "binding": b})
    assert out["execution_status"] == "inconclusive" and out["primary_value"]["eligible_subgroup_count"] == 1
    models = [{"model_id": "last", "kind": "last_observation"}, {"model_id": "trend", "kind": "linear_trend"}]
    p = {"models": models, "time_field": "day", "outcome_field": "v", "horizon_steps": 1, "minimum_history": 3, "baseline_model_id": "last", "minimum_improvement": 0.1}
    out = experiments.run_analysis(spark, {"layer": "predictive", "data_source": SOURCE, "binding": p})
    assert out["primary_value"] == {"comparison_result": "candidate_wins", "selected_model_id": "trend"}
    shared = {"unit_id_field": "x", "split_field": "g", "discovery_value": "a", "estimation_value": "b"}
    assert experiments.run_analysis(spark, {"layer": "honest_heterogeneity", "data_source": SOURCE, "binding": b | shared})["execution_status"] == "unverifiable"
    assert experiments.run_analysis(spark, {"layer": "nothing", "data_source": SOURCE})["execution_status"] == "invalid_spec"
    assert experiments.run_analysis(spark, {"layer": "decision", "data_source": SOURCE, "binding": {}})["execution_status"] == "invalid_spec"


DESIGN = {
    "identification_strategy": "difference_in_differences", "assignment_mechanism": "observational", "estimator": "difference_in_differences", "intervention": "i", "comparator": "c", "group_field": "g",
    "time_zero": "t0", "followup_end": "t1", "estimand": "ATT", "intervention_value": 1, "comparator_value": 0, "positivity": "supported", "consistency": "supported", "confounder_review_status": "complete",
    "assumptions": [{"name": "a", "status": "supported", "evidence_refs": ["A"]}], "known_confounders": [{"name": "k", "status": "measured"}], "design_evidence_refs": ["D"],
    "identification_checks": {n: {"status": "supported", "evidence_refs": [n]} for n in ("parallel_trends", "no_anticipation")},
}
QUESTION = {
    "question": "q", "objective": "estimate_effect", "outcome_field": "v", "unit": "u", "metric_definition": "m", "time_field": "t", "causal_design": DESIGN,
    "readiness": dict.fromkeys(("exposure_observed", "temporal_order_known", "comparison_groups", "repeated_units", "pre_post_periods"), True),
    "data_generating_process": {"selection_process": "s", "mechanism_edges": [{"source": "x", "target": "y", "relation": "causes", "evidence_refs": ["A"]}]},
}
CARDS = {"A": {"verified": True}, "D": {"verified": True, "lane": "identification_design"}} | {
    n: {"verified": True, "lane": "identification_check", "identification_check_binding": {"check_name": n, "status": "supported"}} for n in ("parallel_trends", "no_anticipation", "assignment_integrity")
}


def causal(cards=CARDS, question=None, **design):
    out = control.compile_question(QUESTION | (question or {}) | {"causal_design": DESIGN | design}, cards)
    return out["layers"]["causal"], out["claim_permissions"]["causal"]


def test_question_layers():
    assert control.required_layers("describe") == ["measurement", "descriptive"]
    assert causal() == ({"status": "ready", "missing": []}, True)
    assert control.compile_question(QUESTION, CARDS)["layers"]["predictive"]["status"] == "not_requested"
    assert control.compile_question({})["status"] == "invalid_spec"


CHECKS = DESIGN["identification_checks"]
RANDOM = {"identification_strategy": "randomized", "estimator": "group_mean_difference", "identification_checks": {"assignment_integrity": {"status": "supported", "evidence_refs": ["assignment_integrity"]}}}


@pytest.mark.parametrize(("status", "missing", "change"), [
    *(("conditional", name, {name: None}) for name in ("intervention", "comparator", "group_field", "time_zero", "followup_end", "estimand", "intervention_value", "comparator_value")),
    ("blocked", "an estimator that fits the strategy", {"estimator": None}),
    ("blocked", "an estimator that fits the strategy", {"estimator": "group_mean_difference"}),
    ("blocked", "a strategy that fits unrandomised assignment", RANDOM),
    ("blocked", "a strategy that uses the randomisation", {"assignment_mechanism": "randomized"}),
    ("conditional", "a known assignment mechanism", {"assignment_mechanism": "chosen", "known_confounders": []}),
    ("conditional", "a known identification strategy", {"identification_strategy": "none"}),
    ("conditional", "identifying assumptions", {"assumptions": []}),
    ("conditional", "assumption a", {"assumptions": [{"name": "a", "status": "untested"}]}),
    ("blocked", "assumption a", {"assumptions": [{"name": "a", "status": "violated"}]}),
    ("conditional", "evidence of assumption a", {"assumptions": [{"name": "a", "status": "supported", "evidence_refs": []}]}),
    ("conditional", "evidence of assumption a", {"assumptions": [{"name": "a", "status": "supported", "evidence_refs": ["nobody"]}]}),
    ("conditional", "positivity", {"positivity": "uncertain"}),
    ("blocked", "consistency", {"consistency": "violated"}),
    ("conditional", "a completed review of confounders", {"confounder_review_status": "open"}),
    ("blocked", "confounder k", {"known_confounders": [{"name": "k", "status": "unmeasured"}]}),
    ("conditional", "evidence of the design", {"design_evidence_refs": ["A"]}),
    ("conditional", "no_anticipation", {"identification_checks": CHECKS | {"no_anticipation": {"status": "uncertain", "evidence_refs": ["no_anticipation"]}}}),
    ("blocked", "no_anticipation", {"identification_checks": CHECKS | {"no_anticipation": {"status": "violated", "evidence_refs": ["no_anticipation"]}}}),
    ("conditional", "evidence of no_anticipation", {"identification_checks": CHECKS | {"no_anticipation": {"status": "supported", "evidence_refs": ["parallel_trends"]}}}),
])
def test_causal_design_gates(status, missing, change):
    layer, permitted = causal(**change)
    assert layer["status"] == status and missing in layer["missing"] and not permitted


@pytest.mark.parametrize(("status", "missing", "change"), [
    ("blocked", "a ready measurement layer", {"metric_definition": None}),
    ("blocked", "a ready temporal layer", {"time_field": None}),
    *(("blocked", name, {"readiness": {**QUESTION["readiness"], name: False}}) for name in ("comparison_groups", "repeated_units", "pre_post_periods")),
    ("blocked", "observed assignment", {"readiness": {**QUESTION["readiness"], "exposure_observed": False}}),
    ("conditional", "known temporal order", {"readiness": {**QUESTION["readiness"], "temporal_order_known": False}}),
    ("conditional", "mechanism edges", {"data_generating_process": {"selection_process": "s"}}),
    ("conditional", "the selection process", {"data_generating_process": {"mechanism_edges": QUESTION["data_generating_process"]["mechanism_edges"]}}),
])
def test_causal_question_gates(status, missing, change):
    layer, permitted = causal(question=change)
    assert layer["status"] == status and missing in layer["missing"] and not permitted


def test_causal_evidence_must_be_verified():
    for name in CARDS.keys() - {"assignment_integrity"}:
        assert not causal(cards=CARDS | {name: CARDS[name] | {"verified": False}})[1]
    assert not causal(cards={})[1]
    layer, permitted = causal(**RANDOM, assignment_mechanism="randomized", assumptions=[], known_confounders=[{"name": "k", "status": "unmeasured"}])
    assert (layer, permitted) == ({"status": "ready", "missing": []}, True)


def test_routes():
    assert control.route("g", {"table": 4, "repeated_exports": 3})["route"] == "repeated_operational_tables"
    assert control.route("g", {"document": 3})["tier"] == "default" and control.route("g", {"document": 30})["tier"] == "evidence"
    assert control.recognize_dimensions("price then volume", {"volume": ["volume"], "price": ["price"], "x": ["zzz"]}) == ["price", "volume"]


def test_angles_and_findings():
    good = {"candidate_id": "a", "status": "adopted", "evidence_refs": ["e"], **dict.fromkeys(control.ANGLE_FIELDS, "t")}
    ok = {"attempted": True, "succeeded": True, "request_count": 1}
    assert control.compile_angles("q", [good], {"e": "verified"}, ok)["adopted"] == ["a"]
    assert control.compile_angles("q", [good], {"e": "open"}, ok)["adopted"] == []
    with pytest.raises(SpecError):
        control.compile_angles("q", [good] * 9, {}, ok)
    with pytest.raises(SpecError):
        control.compile_angles("q", [good], {}, {"attempted": False, "succeeded": True, "request_count": 0})
    question = {"claim_permissions": {"descriptive": True, "causal": False}}
    f = {"finding_id": "f", "claim": "A is above B", "claim_type": "descriptive", "counterexample": "c", "alternative": "d", "evidence_refs": ["e"], "result_id": "r", "result": {"v": 1}}
    assert control.compile_findings([f], question, {"e": "verified"}, {"r": {"v": 1}})["adopted"] == ["f"]
    assert control.compile_findings([f], question, {"e": "verified"}, {"r": {"v": 2}})["adopted"] == []
    assert control.compile_findings([f | {"claim": "A causes B"}], question, {"e": "verified"}, {"r": {"v": 1}})["adopted"] == []


def test_ledgers():
    assert control.retention(["x", "y"], {"E0-R001": "kept"})["missing"] == ["E0-R002"]
    assert control.independence_errors([{"unit_id": "1"}], [{"unit_id": "1", "group_id": "g"}]) == ["unit_id 1 is in both"]
    plan = control.plan_batches([("f", "b"), ("f", "a"), ("f", "c")], 2)
    assert [b["ids"] for b in plan] == [["a", "b"], ["c"]]
    again = control.plan_batches([("f", "b"), ("f", "a"), ("f", "z")], 2, {b["batch"]: b["fingerprint"] for b in plan})
    assert [b["status"] for b in again] == ["reused", "pending"]


def test_registry(spark):
    assert registry.self_check() == []
    df = spark.createDataFrame([("1",)], "v string")
    assert registry.execute("table-profile@1.0.0", df).status == "completed"
    assert registry.execute("table-profile@9.0.0", df).status == "invalid_spec"
    assert registry.execute("robust-anomaly@1.0.0", df, "v", 3.5, []).status == "unverifiable"
    with pytest.raises(ValueError):
        registry.operator("table-profile")(table.profile)


def test_scope_and_gates():
    ok = {"attempted": True, "succeeded": True, "request_count": 1}
    shared = {"shared_object_status": "confirmed", "shared_problem_status": "confirmed", "evidence_refs": ["e"]}
    fam = [{"family_id": "f", "sources": ["a"], "excluded": ["b"]}]
    assert control.compile_scope("q", shared, fam, ["a", "b"], {"e": "verified"}, ok)["verdict"] == "one_scope"
    assert control.compile_scope("q", shared, fam, ["a", "b", "c"], {"e": "verified"}, ok) == {"decision_question": "q", "verdict": "by_family", "unassigned": ["c"], "errors": []}
    assert control.compile_scope("q", shared, [*fam, {"family_id": "g", "sources": ["a"]}], ["a"], {"e": "open"}, ok)["verdict"] == "blocked"
    out = control.record_progress({"f": [True, False]}, "f", False)
    assert out["stable"] and not control.record_progress({}, "f", False)["stable"]
    assert control.gate({"a": True, "b": False}, ["a", "b", "c"]) == {"passed": False, "failed": ["b", "c"], "missing": ["c"]}
