"""Policy evaluation and declared actions against plain Python over rows; bootstraps against resampled rows."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quernstone.operators import inference, policy
from quernstone.plans import experiments

ACTIONS = ["a", "b"]


def log(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.choice([0.3, 0.5, 0.7])
        action = "a" if rng.random() < p else "b"
        rows.append({"act": action, "prop": p if action == "a" else 1 - p, "reward": (3.0 if action == "a" else 1.0) + rng.random(), "unit": f"u{i % 17}", "pa": 0.9, "pb": 0.1, "ql": 2.0 if action == "a" else 1.0, "q": 2.4})
    return rows


def binding(**more):
    return {
        "action_values": ACTIONS, "logged_action_field": "act", "propensity_field": "prop", "reward_field": "reward", "bootstrap_unit_field": "unit", "q_logged_field": "ql",
        "policy_specs": [
            {"policy_id": "old", "policy_type": "logging_policy", "q_policy_field": "q"}, {"policy_id": "even", "policy_type": "uniform_policy", "q_policy_field": "q"},
            {"policy_id": "new", "policy_type": "action_probabilities", "action_probability_fields": {"a": "pa", "b": "pb"}, "q_policy_field": "q"},
        ],
        "action_options": ["old", "even", "new"], "baseline_action": "old", "fallback_action": "old", "estimators": ["ips", "snips"], "primary_estimator": "ips", "minimum_effective_sample_size": 3, "maximum_importance_weight": 5,
        "minimum_advantage": 0.01, "confidence_level": 0.8, "bootstrap_replicates": 60, "bootstrap_seed": 7, "weight_clip_grid": [2, 4], "propensity_floor_grid": [0.05, 0.4],
    } | more


def run(spark, rows, b):
    return experiments.run_analysis(spark, {"layer": "offline_policy", "data_source": {"rows": rows}, "binding": b})


def target(policy_id, r):
    return {"old": r["prop"], "even": 0.5, "new": r["pa" if r["act"] == "a" else "pb"]}[policy_id]


def value(rows, policy_id, kind, clip=math.inf, floor=0.0):
    w = [min(target(policy_id, r) / max(r["prop"], floor), clip) for r in rows]
    if kind == "ips":
        return statistics.fmean(x * r["reward"] for x, r in zip(w, rows, strict=True))
    if kind == "snips":
        return sum(x * r["reward"] for x, r in zip(w, rows, strict=True)) / sum(w)
    return statistics.fmean(r["q"] + x * (r["reward"] - r["ql"]) for x, r in zip(w, rows, strict=True))


def times(seed, rep, unit):
    bits, k, total = int(hashlib.md5(f"{seed}:{rep}:{unit}".encode()).hexdigest()[:8], 16), 0, math.exp(-1)
    while bits >= math.floor(total * 2**32) and k < 12:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def percentile(xs, p):
    xs, at = sorted(xs), p * (len(xs) - 1)
    i = math.floor(at)
    return xs[i] + (at - i) * (xs[min(i + 1, len(xs) - 1)] - xs[i])


@pytest.mark.parametrize("primary", ["ips", "snips", "doubly_robust"])
def test_evaluation_equals_rows(spark, primary):
    rows, b = log(), binding(estimators=["ips", "snips", "doubly_robust"], primary_estimator=primary)
    out = run(spark, rows, b)
    for p in out["policies"]:
        for kind in b["estimators"]:
            assert p[kind] == pytest.approx(value(rows, p["policy_id"], kind), abs=1e-9)
        by = {}
        for r in rows:
            by[r["unit"]] = by.get(r["unit"], 0) + target(p["policy_id"], r) / r["prop"]
        assert p["effective_sample_size"] == pytest.approx(sum(by.values()) ** 2 / sum(x * x for x in by.values()))
        assert p["maximum_observed_importance_weight"] == pytest.approx(max(target(p["policy_id"], r) / r["prop"] for r in rows))
    for s in out["sensitivity_results"]:
        values = {p: value(rows, p, s["estimator"], s["weight_clip"], s["propensity_floor"]) for p in ("old", "even", "new")}
        assert s["best_policy_id"] == max(values, key=values.get)
    for c in out["policy_comparisons"]:
        deltas = []
        for rep in range(60):
            drawn = [r for r in rows for _ in range(times(7, rep, r["unit"]))]
            deltas.append(value(drawn, c["candidate_policy_id"], primary) - value(drawn, "old", primary))
        assert [c["lower"], c["upper"]] == pytest.approx([percentile(deltas, 0.05), percentile(deltas, 0.95)], abs=1e-8)
        assert c["valid_bootstrap_replicates"] == 60


def test_selection_and_reasons(spark):
    clear = run(spark, log(400), binding())
    assert clear["primary_value"]["decision_status"] == "policy_selected" and clear["primary_value"]["selected_policy_id"] == "new" and not clear["primary_value"]["failure_reasons"]
    strict = run(spark, log(400), binding(minimum_advantage=50))
    assert strict["primary_value"]["selected_policy_id"] == "old" and "point_advantage_below_threshold" in strict["primary_value"]["failure_reasons"]
    assert {"advantage_interval_does_not_clear_threshold", "estimator_disagreement", "sensitivity_result_unstable"} <= set(strict["primary_value"]["failure_reasons"])
    tight = run(spark, log(400), binding(maximum_importance_weight=1.5))
    assert tight["primary_value"]["failure_reasons"] == ["overlap_diagnostic_failed"]
    none = run(spark, log(400), binding(minimum_effective_sample_size=1e6))
    assert none["execution_status"] == "inconclusive" and none["primary_value"]["selected_policy_id"] is None and none["primary_value"]["decision_status"] == "unsupported_fallback"


@pytest.mark.parametrize("field, bad", [("act", "c"), ("act", None), ("prop", 0), ("prop", 1.2), ("prop", "x"), ("reward", None), ("unit", " "), ("pa", 0.8), ("pb", -0.1)])
def test_faulty_rows_are_unverifiable(spark, field, bad):
    out = run(spark, [*log(20), log(1)[0] | {field: bad}], binding())
    assert out["execution_status"] == "unverifiable" and "1 rows" in out["errors"][0]


@pytest.mark.parametrize("more", [{"fallback_action": "x"}, {"primary_estimator": "dr"}, {"confidence_level": 1}, {"weight_clip_grid": []}, {"action_options": ["old"]}, {"bootstrap_replicates": 0}])
def test_faulty_specs(spark, more):
    assert run(spark, log(20), binding(**more))["execution_status"] == "invalid_spec"


def test_unsupported_policy(spark):
    rows = [r | {"act": "b", "pa": 1.0, "pb": 0.0} for r in log(20)]
    assert run(spark, rows, binding())["execution_status"] == "unverifiable"


def decide(spark, rows, **more):
    b = {"action_options": ["x", "y"], "action_field": "act", "benefit_field": "gain", "cost_field": "cost", "baseline_action": "x", "fallback_action": "x", "minimum_net_utility": 1, "minimum_advantage": 1} | more
    return experiments.run_analysis(spark, {"layer": "decision", "data_source": {"rows": rows}, "binding": b})


def test_declared_actions(spark):
    rows = [{"act": "x", "gain": 5, "cost": 2, "risk": 1, "p": 1, "w": 1}, {"act": "y", "gain": 10, "cost": 1, "risk": 4, "p": 0.5, "w": 3}, {"act": "y", "gain": 20, "cost": 1, "risk": 8, "p": 1, "w": 1}, {"act": "z", "gain": "?", "cost": 0, "risk": 0, "p": 9, "w": -1}]
    plain = decide(spark, rows)
    assert plain["primary_value"] == {"selected_action": "y", "decision_status": "action_selected", "selected_expected_net_utility": 14.0, "best_action": "y", "best_action_advantage_over_baseline": 11.0, "utility_margin": 13.0, "advantage_margin": 10.0}
    weighted = decide(spark, rows, probability_field="p", weight_field="w")
    assert weighted["primary_value"]["selected_expected_net_utility"] == 7.75
    risk = {"field": "risk", "aggregation": "mean", "operator": "lte", "value": 5}
    held = decide(spark, rows, constraint_rules=[risk])
    assert held["primary_value"]["selected_action"] == "x" and held["primary_value"]["decision_status"] == "fallback_selected" and [a["feasible"] for a in held["actions"]] == [True, False]
    assert decide(spark, rows, constraint_rules=[risk | {"value": 0}])["primary_value"]["decision_status"] == "no_feasible_fallback"
    assert decide(spark, rows, minimum_advantage=12)["primary_value"]["decision_status"] == "fallback_selected"
    assert decide(spark, rows, action_options=["x", "y", "q"])["execution_status"] == "unverifiable"
    assert decide(spark, rows, action_options=["x", "z"])["execution_status"] == "unverifiable"


def test_block_bootstrap_by_digests(spark):
    rng = random.Random(4)
    gains = [rng.gauss(1, 2) for _ in range(17)]
    frame = spark.createDataFrame(list(enumerate(gains)), "origin long, gain double")
    got = inference.block_bootstrap_interval(frame, 17, 0.9, 100, 9, 4, digests=True).first()
    means = []
    for rep in range(100):
        sample = []
        for k in range(5):
            start = int(hashlib.md5(f"9:{rep}:{k}".encode()).hexdigest()[:8], 16) % 17
            sample += [gains[(start + j) % 17] for j in range(4)]
        means.append(statistics.fmean(sample[:17]))
    assert [got.lower, got.upper] == pytest.approx([percentile(means, 0.05), percentile(means, 0.95)], abs=1e-9)


def test_multiplicities_are_poisson(spark):
    k = spark.range(40000).select(inference.poisson_times(1, F.col("id") % 50, F.col("id")).alias("k"))
    mean, variance, zero = k.agg(F.avg("k"), F.var_pop("k"), F.avg((F.col("k") == 0).cast("int"))).first()
    assert abs(mean - 1) < 0.02 and abs(variance - 1) < 0.04 and abs(zero - math.exp(-1)) < 0.01


def test_predictive_intervals(spark):
    rows = [{"day": f"2024-01-{d:02d}", "v": d * 2 + (d % 3)} for d in range(1, 29)]
    models = [{"model_id": "last", "kind": "last_observation"}, {"model_id": "trend", "kind": "linear_trend"}]
    b = {"models": models, "time_field": "day", "outcome_field": "v", "horizon_steps": 1, "minimum_history": 4, "baseline_model_id": "last", "minimum_improvement": 0.01, "bootstrap_replicates": 80, "bootstrap_block_length": 3}
    out = experiments.run_analysis(spark, {"layer": "predictive", "data_source": {"rows": rows}, "binding": b})
    low, high = out["gain_intervals"]["trend"]
    assert low <= high and out["primary_value"]["comparison_result"] == ("candidate_wins" if low > 0 else "uncertain_difference")


def test_long_sequences_are_refused(spark):
    frame = spark.createDataFrame([(i, 1.0) for i in range(10)], "origin long, gain double")
    with pytest.raises(ValueError, match="digests"):
        inference.block_bootstrap_interval(frame, 10, 0.9, 1_000_000, 9, 1)
