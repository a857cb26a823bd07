"""Offline evaluation of policies over logged actions, and the choice between declared actions.

Logged rows are read once into sums by unit, with columns for every declared
policy; values, overlap and the bootstrap all come from these sums. Only tables
whose size is declared (policies, clips times floors, candidates) reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import SpecError, predicate
from ..functions.types import finite, strict_number, text
from .inference import DIGITS, poisson_times

ESTIMATORS = ("ips", "snips", "doubly_robust")
#: A policy's probabilities may miss one by this much.
TOLERANCE = 1e-7
#: The share of replicates that must be valid for an interval.
VALID_SHARE = 0.8


class DataProblem(ValueError):
    """The rows don't bear the evaluation that the spec asks for."""


def _number(rows: DataFrame, name: str) -> Column:
    """The strict number of a column; one that holds numbers needn't be read as text."""
    if isinstance(rows.schema[name].dataType, (T.IntegralType, T.FractionalType)):
        return finite(F.col(f"`{name}`").cast("double"))
    return strict_number(F.col(f"`{name}`"))


def _raise_on(rows: DataFrame, faults: dict[str, Column]) -> None:
    """One pass that counts the rows of every fault."""
    found = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in faults.items())).first().asDict()
    if not found.pop("_rows"):
        raise DataProblem("no rows")
    if any(found.values()):
        raise DataProblem("; ".join(f"{name}: {n} rows" for name, n in found.items() if n))


def logged_rows(rows: DataFrame, b: dict[str, Any]) -> DataFrame:
    """(unit, reward, propensity, q_logged, policies): the checked log, with target probability and value of every policy.

    policy_type logging_policy repeats the log, uniform_policy spreads evenly over
    action_values, any other reads action_probability_fields. A fault in any row is a DataProblem.
    """
    action, unit = text(F.col(f"`{b['logged_action_field']}`")), text(F.col(f"`{b['bootstrap_unit_field']}`"))
    propensity, reward = _number(rows, b["propensity_field"]), _number(rows, b["reward_field"])
    doubly = "doubly_robust" in b["estimators"]
    q_logged = _number(rows, b["q_logged_field"]) if doubly else F.lit(0.0)
    faults = {
        "action outside action_values": ~action.isin(*b["action_values"]), "missing unit": unit.isNull() | (unit == ""), "propensity outside (0, 1]": ~((propensity > 0) & (propensity <= 1)),
        "reward is no number": reward.isNull(), "q_logged is no number": q_logged.isNull(),
    }
    policies = []
    for p in b["policy_specs"]:
        if p["policy_type"] == "logging_policy":
            target = propensity
        elif p["policy_type"] == "uniform_policy":
            target = F.lit(1 / len(b["action_values"]))
        else:
            by = {v: _number(rows, p["action_probability_fields"][v]) for v in b["action_values"]}
            total = reduce(add, by.values())
            faults[f"{p['policy_id']}: a probability outside 0 to 1"] = reduce(or_, (~c.between(0, 1) for c in by.values()))
            faults[f"{p['policy_id']}: probabilities don't sum to 1"] = F.abs(total - 1) > TOLERANCE * F.greatest(total, F.lit(1.0))
            target = F.coalesce(*(F.when(action == v, c) for v, c in by.items()))
        q = _number(rows, p["q_policy_field"]) if doubly else F.lit(0.0)
        faults[f"{p['policy_id']}: q is no number"] = q.isNull()
        policies.append(F.struct(target.alias("target"), q.alias("q")))
    _raise_on(rows, faults)
    return rows.select(unit.alias("unit"), reward.alias("reward"), propensity.alias("propensity"), q_logged.alias("q_logged"), F.array(*policies).alias("policies"))


def _sums(i: int, weight: Column) -> list[Column]:
    """Sums from which the i-th policy's three estimates follow, under one weight."""
    q = F.col("policies")[i]["q"]
    return [F.sum(weight).alias(f"w{i}"), F.sum(weight * F.col("reward")).alias(f"wr{i}"), F.sum(q + weight * (F.col("reward") - F.col("q_logged"))).alias(f"dr{i}")]


def unit_sums(logged: DataFrame, b: dict[str, Any]) -> DataFrame:
    """One row a unit: its rows, and for every policy the sums, the largest weight and the rows of positive weight."""
    out = [F.count(F.lit(1)).alias("n")]
    for i in range(len(b["policy_specs"])):
        w = F.col("policies")[i]["target"] / F.col("propensity")
        out += [*_sums(i, w), F.max(w).alias(f"top{i}"), F.count_if(w > 0).alias(f"positive{i}")]
    return logged.groupBy("unit").agg(*out)


def _estimate(kind: str, i: int, n: Column) -> Column:
    """IPS, SNIPS (null without support) or doubly robust value from aggregated sums."""
    w, wr, dr = (F.col(f"{k}{i}") for k in ("w", "wr", "dr"))
    return {"ips": F.try_divide(wr, n), "snips": F.when(w > 0, wr / w), "doubly_robust": F.try_divide(dr, n)}[kind]


def policy_table(units: DataFrame, b: dict[str, Any]) -> DataFrame:
    """Values, clustered effective sample size, support and overlap of every policy."""
    specs = b["policy_specs"]
    sums = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("independent_unit_count")]
    for i in range(len(specs)):
        sums += [F.sum(f"{k}{i}").alias(f"{k}{i}") for k in ("w", "wr", "dr", "positive")]
        sums += [F.sum(F.col(f"w{i}") * F.col(f"w{i}")).alias(f"ww{i}"), F.max(f"top{i}").alias(f"top{i}"), F.count_if(F.col(f"positive{i}") > 0).alias(f"units{i}")]
    one = units.agg(*sums)
    lines = []
    for i, p in enumerate(specs):
        w, ww, top = (F.col(f"{k}{i}") for k in ("w", "ww", "top"))
        size = F.coalesce(F.try_divide(w * w, ww), F.lit(0.0))
        supported = (size >= float(b["minimum_effective_sample_size"])) & (top <= float(b["maximum_importance_weight"]))
        lines.append(
            F.struct(
                F.lit(p["policy_id"]).alias("policy_id"), *(F.round(_estimate(k, i, F.col("n")), DIGITS).alias(k) for k in b["estimators"]), F.round(size, DIGITS).alias("effective_sample_size"),
                F.round(top, DIGITS).alias("maximum_observed_importance_weight"), F.col(f"positive{i}").alias("positive_weight_row_count"), "independent_unit_count",
                F.col(f"units{i}").alias("positive_weight_unit_count"), F.when(supported, "supported").otherwise("failed").alias("overlap_status"),
            )
        )
    return one.select(F.inline(F.array(*lines)))


def _candidates(b: dict[str, Any]) -> list[str]:
    return [p for p in b["action_options"] if p != b["baseline_action"]]


def policy_comparisons(units: DataFrame, b: dict[str, Any]) -> DataFrame:
    """Advantage of every candidate on the baseline, with its bootstrap interval by whole units.

    A unit's multiplicity is Poisson, drawn from a digest of seed, replicate and unit,
    so all candidates share the draws and no draw leaves its task: what is shuffled is a row
    a replicate from each task. The level is divided among the candidates; an interval of fewer
    than VALID_SHARE valid replicates is null.
    """
    place = {p["policy_id"]: i for i, p in enumerate(b["policy_specs"])}
    names, base, kind = _candidates(b), place[b["baseline_action"]], b["primary_estimator"]
    used = sorted({base, *(place[c] for c in names)})
    replicates = int(b["bootstrap_replicates"])
    alpha = (1 - float(b["confidence_level"])) / max(1, len(names))

    n, rep = F.col("n"), F.col("rep")
    drawn = units.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))  # -1 is the sample as it is
    drawn = drawn.withColumn("k", F.when(rep < 0, 1).otherwise(poisson_times(int(b["bootstrap_seed"]), rep, F.col("unit")))).filter("k > 0")
    k = F.col("k")
    totals = drawn.groupBy("rep").agg(F.sum(k * n).alias("n"), *(F.sum(k * F.col(f"{s}{i}")).alias(f"{s}{i}") for i in used for s in ("w", "wr", "dr")))
    deltas = totals.select("rep", *(F.round(_estimate(kind, place[c], n) - _estimate(kind, base, n), DIGITS).alias(f"d{j}") for j, c in enumerate(names)))
    ends = []
    for j in range(len(names)):
        d = F.when(rep >= 0, F.col(f"d{j}"))
        ends += [F.max(F.when(rep < 0, F.col(f"d{j}"))).alias(f"point{j}"), F.percentile(d, alpha / 2).alias(f"lower{j}"), F.percentile(d, 1 - alpha / 2).alias(f"upper{j}"), F.count(d).alias(f"valid{j}")]
    lines = []
    for j, c in enumerate(names):
        enough = F.col(f"valid{j}") >= math.ceil(replicates * VALID_SHARE)
        lines.append(
            F.struct(
                F.lit(c).alias("candidate_policy_id"), F.col(f"point{j}").alias("advantage_over_baseline"), *(F.when(enough, F.round(f"{side}{j}", DIGITS)).alias(side) for side in ("lower", "upper")),
                F.col(f"valid{j}").alias("valid_bootstrap_replicates"),
            )
        )
    return deltas.agg(*ends).select(F.inline(F.array(*lines)))


def policy_grid(logged: DataFrame, b: dict[str, Any]) -> DataFrame:
    """(weight_clip, propensity_floor, estimator, policy_id, value) for every scenario, from one pass over the log.

    Each row meets the declared clips and floors as a literal array and leaves its task as one row a scenario.
    """
    scenarios = F.array(*(F.struct(F.lit(float(c)).alias("clip"), F.lit(float(f)).alias("floor")) for c in b["weight_clip_grid"] for f in b["propensity_floor_grid"]))
    cells = logged.select("*", F.inline(scenarios))
    sums = [F.count(F.lit(1)).alias("n")]
    for i in range(len(b["policy_specs"])):
        sums += _sums(i, F.least(F.col("policies")[i]["target"] / F.greatest("propensity", "floor"), F.col("clip")))
    lines = [
        F.struct(F.lit(k).alias("estimator"), F.lit(p["policy_id"]).alias("policy_id"), F.round(_estimate(k, i, F.col("n")), DIGITS).alias("value"))
        for i, p in enumerate(b["policy_specs"]) for k in b["estimators"]
    ]
    return cells.groupBy("clip", "floor").agg(*sums).select(F.col("clip").alias("weight_clip"), F.col("floor").alias("propensity_floor"), F.inline(F.array(*lines)))


def _first(values: dict[str, float]) -> str:
    return min(values, key=lambda p: (-values[p], p))


def _stability(values: dict[str, float | None], best: str, b: dict[str, Any]) -> dict[str, Any]:
    """Whether best stays ahead of all and far enough ahead of the baseline."""
    if None in values.values():
        raise DataProblem("a policy has no logged support")
    advantage = values[best] - values[b["baseline_action"]]
    return {"best_policy_id": _first(values), "candidate_advantage_over_baseline": round(advantage, DIGITS), "selected_candidate_stable": _first(values) == best and advantage >= float(b["minimum_advantage"])}


def policy_spec_errors(b: dict[str, Any]) -> list[str]:
    """What a declared evaluation lacks; checked before any row is read."""
    ids = [p.get("policy_id") for p in b["policy_specs"]]
    tests = {
        "policy ids must be distinct": len(set(ids)) == len(ids), "action_options must be declared policies, two or more": set(b["action_options"]) <= set(ids) and len(set(b["action_options"])) > 1,
        "baseline and fallback must be declared policies": {b["baseline_action"], b["fallback_action"]} <= set(ids), "baseline must be an option": b["baseline_action"] in b["action_options"],
        "estimators must be known": bool(b["estimators"]) and set(b["estimators"]) <= set(ESTIMATORS), "primary_estimator must be one of estimators": b["primary_estimator"] in b["estimators"],
        "confidence_level must lie between 0 and 1": 0 < float(b["confidence_level"]) < 1, "bootstrap_replicates must be positive": int(b["bootstrap_replicates"]) > 0,
        "clips and floors must be positive": bool(b["weight_clip_grid"]) and bool(b["propensity_floor_grid"]) and min(map(float, b["weight_clip_grid"])) > 0 and min(map(float, b["propensity_floor_grid"])) >= 0,
        "action_values must not be empty": bool(b["action_values"]),
    }
    return [what for what, holds in tests.items() if not holds]


def evaluate_policies(rows: DataFrame, b: dict[str, Any]) -> dict[str, Any]:
    """The best candidate if every condition clears, else the fallback with the reasons; no selection if the fallback lacks overlap."""
    wrong = policy_spec_errors(b)
    if wrong:
        raise SpecError("; ".join(wrong))
    logged = logged_rows(rows, b)
    units = unit_sums(logged, b).persist()
    try:
        policies = {r["policy_id"]: r.asDict() for r in policy_table(units, b).collect()}
        primary, base, least = b["primary_estimator"], b["baseline_action"], float(b["minimum_advantage"])
        by_estimator = {k: {name: p[k] for name, p in policies.items()} for k in b["estimators"]}
        if any(None in v.values() for v in by_estimator.values()):
            raise DataProblem("a policy has no logged support")
        best = _first({c: by_estimator[primary][c] for c in _candidates(b)})
        comparisons = [r.asDict() for r in policy_comparisons(units, b).collect()]
        scenarios: dict[tuple, dict[str, float]] = {}
        for r in policy_grid(logged, b).collect():
            scenarios.setdefault((r["estimator"], r["weight_clip"], r["propensity_floor"]), {})[r["policy_id"]] = r["value"]
    finally:
        units.unpersist()
    agreement = [{"estimator": k} | _stability(v, best, b) for k, v in by_estimator.items()]
    sensitivity = [{"estimator": k, "weight_clip": c, "propensity_floor": f} | _stability(v, best, b) for (k, c, f), v in sorted(scenarios.items())]
    advantage = by_estimator[primary][best] - by_estimator[primary][base]
    own = next(c for c in comparisons if c["candidate_policy_id"] == best)
    overlap = all(policies[p]["overlap_status"] == "supported" for p in (best, base, b["fallback_action"]))
    conditions = {
        "point_advantage_below_threshold": advantage >= least, "advantage_interval_does_not_clear_threshold": own["lower"] is not None and own["lower"] > least, "overlap_diagnostic_failed": overlap,
        "estimator_disagreement": all(x["selected_candidate_stable"] for x in agreement), "sensitivity_result_unstable": all(x["selected_candidate_stable"] for x in sensitivity),
    }
    reasons = [name for name, holds in conditions.items() if not holds]
    usable = policies[b["fallback_action"]]["overlap_status"] == "supported"
    chosen = b["fallback_action"] if reasons else best
    return {
        "execution_status": "completed" if usable else "inconclusive",
        "primary_value": {
            "selected_policy_id": chosen if usable else None, "decision_status": ("fallback_selected" if reasons else "policy_selected") if usable else "unsupported_fallback", "best_candidate_policy_id": best,
            "best_candidate_advantage_over_baseline": round(advantage, DIGITS), "advantage_interval": None if own["lower"] is None else [own["lower"], own["upper"]], "failure_reasons": reasons,
        },
        "policies": list(policies.values()), "policy_comparisons": comparisons, "estimator_stability": agreement, "sensitivity_results": sensitivity,
    }


# declared actions


def action_table(rows: DataFrame, b: dict[str, Any]) -> DataFrame:
    """Weighted expected net utility (probability * benefit - cost) of every declared action, its range and its constraints, in one pass."""
    number = lambda key: _number(rows, b[key]) if b.get(key) else F.lit(1.0)
    p, w, benefit, cost = number("probability_field"), number("weight_field"), _number(rows, b["benefit_field"]), _number(rows, b["cost_field"])
    rules = b.get("constraint_rules") or []
    action = text(F.col(f"`{b['action_field']}`"))
    base = rows.select(action.alias("action"), p.alias("p"), w.alias("w"), benefit.alias("benefit"), cost.alias("cost"), *(_number(rows, r["field"]).alias(f"v{i}") for i, r in enumerate(rules))).filter(F.col("action").isin(*b["action_options"]))
    faults = {"probability outside 0 to 1": ~F.col("p").between(0, 1), "weight not positive": ~(F.col("w") > 0), "benefit or cost is no number": F.col("benefit").isNull() | F.col("cost").isNull()}
    _raise_on(base, faults | {f"{r['field']} is no number": F.col(f"v{i}").isNull() for i, r in enumerate(rules)})
    net = F.col("p") * F.col("benefit") - F.col("cost")
    kinds = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    observed = [F.round(kinds[r["aggregation"]](f"v{i}"), DIGITS).alias(f"v{i}") for i, r in enumerate(rules)]
    by = base.groupBy("action").agg(
        F.count(F.lit(1)).alias("scenario_count"), F.round(F.sum(F.col("w") * net) / F.sum("w"), DIGITS).alias("expected_net_utility"), F.round(F.min(net), DIGITS).alias("minimum"), F.round(F.max(net), DIGITS).alias("maximum"), *observed
    )
    checks = [F.struct(F.lit(r["field"]).alias("field"), F.lit(r["aggregation"]).alias("aggregation"), F.col(f"v{i}").alias("observed"), F.coalesce(predicate(F.col(f"v{i}"), r), F.lit(False)).alias("passed")) for i, r in enumerate(rules)]
    passed = reduce(lambda a, c: a & c["passed"], checks, F.lit(True))
    return by.select("action", "scenario_count", "expected_net_utility", "minimum", "maximum", (F.array(*checks) if checks else F.lit(None).cast("array<struct<field string, aggregation string, observed double, passed boolean>>")).alias("constraints"), passed.alias("feasible"))


def choose_action(rows: DataFrame, b: dict[str, Any]) -> dict[str, Any]:
    """The feasible action of the highest utility, if it and its advantage on the baseline suffice; else the fallback, if feasible."""
    by = {r["action"]: r.asDict(recursive=True) for r in action_table(rows, b).collect()}
    absent = [a for a in b["action_options"] if a not in by]
    if absent:
        raise DataProblem("no rows of " + ", ".join(absent))
    actions = [by[a] for a in b["action_options"]]
    if not by[b["fallback_action"]]["feasible"]:
        return {"execution_status": "inconclusive", "primary_value": {"selected_action": None, "decision_status": "no_feasible_fallback"}, "actions": actions}
    best = _first({a: x["expected_net_utility"] for a, x in by.items() if x["feasible"]})
    margin = by[best]["expected_net_utility"] - float(b["minimum_net_utility"])
    advantage = by[best]["expected_net_utility"] - by[b["baseline_action"]]["expected_net_utility"]
    clears = margin >= 0 and advantage >= float(b["minimum_advantage"])
    chosen = best if clears else b["fallback_action"]
    value = {
        "selected_action": chosen, "decision_status": "action_selected" if clears else "fallback_selected", "selected_expected_net_utility": by[chosen]["expected_net_utility"], "best_action": best,
        "best_action_advantage_over_baseline": round(advantage, DIGITS), "utility_margin": round(margin, DIGITS), "advantage_margin": round(advantage - float(b["minimum_advantage"]), DIGITS),
    }
    return {"execution_status": "completed", "primary_value": value, "actions": actions}
