"""The control plane: questions into layers, goals into routes, ledgers with gates.

Small documents in plain Python. Nothing here reads data-plane rows; where rows
decide, an operator brings a one-row aggregate.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from ..functions.predicates import SpecError

LAYERS = ("measurement", "descriptive", "temporal", "heterogeneity", "mechanism", "causal", "predictive", "decision")
OBJECTIVES = ("describe", "compare", "diagnose", "explain", "predict", "estimate_effect", "choose_action")

#: What each identification strategy has to declare, and the checks that have to be supported by evidence.
CAUSAL_CHECKS = {
    "randomized": {"declared": (), "supported": ("assignment_integrity",)},
    "backdoor": {"declared": ("adjustment_set",), "supported": ()},
    "difference_in_differences": {"declared": (), "supported": ("parallel_trends", "no_anticipation")},
    "interrupted_time_series": {"declared": ("intervention_time",), "supported": ("stable_pretrend",)},
    "regression_discontinuity": {"declared": ("running_variable", "cutoff"), "supported": ("continuity",)},
    "instrumental_variable": {"declared": ("instrument",), "supported": ("instrument_relevance", "exclusion_restriction")},
    "frontdoor": {"declared": ("mediator",), "supported": ("frontdoor_criteria",)},
}
#: The states of a check, of positivity and of consistency.
READINESS = ("supported", "uncertain", "violated")
#: Layers by the rule that asks for them; each rule looks at (objective, has time, has a prediction design, basis of the decision).
LAYER_RULES = (
    (lambda o, t, p, d: True, ("measurement", "descriptive")),
    (lambda o, t, p, d: t or o in ("predict", "estimate_effect") or d == "prediction", ("temporal",)),
    (lambda o, t, p, d: o in ("diagnose", "explain", "estimate_effect") or d == "causal_effect", ("heterogeneity", "mechanism")),
    (lambda o, t, p, d: o in ("compare", "choose_action"), ("heterogeneity",)),
    (lambda o, t, p, d: o == "estimate_effect" or d == "causal_effect", ("causal",)),
    (lambda o, t, p, d: o == "predict" or p or d == "prediction", ("predictive",)),
    (lambda o, t, p, d: o == "choose_action", ("decision",)),
)


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def required_layers(objective: str, has_time: bool = False, has_prediction_design: bool = False, decision_basis: str = "") -> list[str]:
    """What a question must cover, in order."""
    asked = {layer for rule, layers in LAYER_RULES if rule(objective, has_time, has_prediction_design, decision_basis) for layer in layers}
    return [x for x in LAYERS if x in asked]


#: What a causal design declares, besides the values of its two groups.
CAUSAL_FIELDS = ("intervention", "comparator", "group_field", "time_zero", "followup_end", "estimand", "estimator")
#: How units came by their treatment; the second group isn't randomised.
ASSIGNMENTS = ("randomized", "as_if_random", "observational", "unknown")
UNRANDOMIZED = ("as_if_random", "observational")
#: Estimators that answer a strategy's question.
ESTIMATORS = {"randomized": ("group_mean_difference", "group_median_difference", "group_rate_difference"), "difference_in_differences": ("difference_in_differences",)}
#: Lanes of evidence for a design and for a check.
DESIGN_LANES = ("experiment_design", "identification_design")
CHECK_LANE = "identification_check"
#: What the data must hold for a strategy: names in readiness, and time_field of the spec.
STRATEGY_DATA = {"randomized": ("comparison_groups",), "difference_in_differences": ("repeated_units", "pre_post_periods", "comparison_groups"), "interrupted_time_series": ("time_field", "pre_post_periods")}


def _sound(refs: list[str], evidence: dict[str, dict[str, Any]], lanes: tuple[str, ...] = (), binding: dict[str, Any] | None = None) -> bool:
    """Whether there are references, all to verified evidence of these lanes, bound to this very check."""
    cards = [evidence.get(r) or {} for r in refs]
    return bool(cards) and all(c.get("verified") is True and (not lanes or c.get("lane") in lanes) and (binding is None or c.get("identification_check_binding") == binding) for c in cards)


def causal_gaps(spec: dict[str, Any], evidence: dict[str, dict[str, Any]], unready: tuple[str, ...] = ()) -> tuple[list[str], bool]:
    """What a causal design lacks, and whether something that it rests on is violated.

    evidence: cards by id, with verified, lane and identification_check_binding;
    unready: layers below this one that are not ready.
    """
    design, readiness, process = (spec.get(k) or {} for k in ("causal_design", "readiness", "data_generating_process"))
    strategy, assignment, estimator = (design.get(k) for k in ("identification_strategy", "assignment_mechanism", "estimator"))
    checks, assumptions, confounders = design.get("identification_checks") or {}, design.get("assumptions") or [], design.get("known_confounders") or []
    gaps: list[tuple[str, bool, bool]] = []  # what is missing, whether it is, whether that violates the design
    lack = lambda what, missing, violates=False: gaps.append((what, bool(missing), violates))

    for layer in ("measurement", "temporal"):
        lack(f"a ready {layer} layer", layer in unready, violates=True)
    for name in CAUSAL_FIELDS:
        lack(name, not design.get(name))
    for name in ("intervention_value", "comparator_value"):
        lack(name, design.get(name) in (None, ""))
    lack("observed assignment", not readiness.get("exposure_observed"), violates=True)
    lack("known temporal order", not readiness.get("temporal_order_known"))
    lack("a known assignment mechanism", assignment not in ASSIGNMENTS)
    lack("a known identification strategy", strategy not in CAUSAL_CHECKS)
    lack("an estimator that fits the strategy", strategy in ESTIMATORS and estimator not in ESTIMATORS[strategy], violates=True)
    lack("a strategy that uses the randomisation", assignment == "randomized" and strategy not in ("randomized", "none", None), violates=True)
    lack("a strategy that fits unrandomised assignment", assignment in UNRANDOMIZED and strategy == "randomized", violates=True)
    for name in STRATEGY_DATA.get(strategy, ()):
        lack(name, not (spec.get(name) if name == "time_field" else readiness.get(name)), violates=True)

    lack("identifying assumptions", assignment in UNRANDOMIZED and not assumptions)
    for x in assumptions:
        lack(f"assumption {x.get('name')}", x.get("status") != "supported", violates=x.get("status") == "violated")
        lack(f"evidence of assumption {x.get('name')}", x.get("status") == "supported" and not _sound(x.get("evidence_refs") or [], evidence))
    for name in ("positivity", "consistency"):
        lack(name, design.get(name) != "supported", violates=design.get(name) == "violated")
    lack("a completed review of confounders", assignment == "observational" and design.get("confounder_review_status") != "complete")
    for x in confounders:
        lack(f"confounder {x.get('name')}", assignment != "randomized" and x.get("status") != "measured", violates=True)
    lack("mechanism edges", not process.get("mechanism_edges"))
    lack("evidence of mechanism edges", not all(_sound(e.get("evidence_refs") or [], evidence) for e in process.get("mechanism_edges") or []))
    lack("the selection process", not process.get("selection_process"))

    for name in CAUSAL_CHECKS.get(strategy, {}).get("declared", ()):
        lack(name, not checks.get(name))
    for name in CAUSAL_CHECKS.get(strategy, {}).get("supported", ()):
        check = checks.get(name) if isinstance(checks.get(name), dict) else {}
        lack(name, check.get("status") != "supported", violates=check.get("status") == "violated")
        bound = {"check_name": name, "status": "supported"}
        lack(f"evidence of {name}", check.get("status") == "supported" and not _sound(check.get("evidence_refs") or [], evidence, (CHECK_LANE,), bound))
    lack("evidence of the design", not _sound(design.get("design_evidence_refs") or [], evidence, DESIGN_LANES))
    return [what for what, missing, _ in gaps if missing], any(missing and violates for _, missing, violates in gaps)


def compile_question(spec: dict[str, Any], evidence: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """Each layer ready, conditional, blocked or not_requested, with what it lacks; no overall score.

    Without evidence (cards by id), nothing that needs any is ready.
    """
    errors = [f"{k} is required" for k in ("question", "objective", "outcome_field", "unit") if not spec.get(k)]
    if spec.get("objective") and spec["objective"] not in OBJECTIVES:
        errors.append("objective is unknown")
    if errors:
        return {"status": "invalid_spec", "errors": errors}
    needed = required_layers(spec["objective"], bool(spec.get("time_field")), bool(spec.get("prediction_design")), spec.get("decision_basis", ""))
    lacks: dict[str, list[str]] = {
        "measurement": [] if spec.get("metric_definition") else ["metric_definition"],
        "descriptive": [],
        "temporal": [] if spec.get("time_field") else ["time_field"],
        "heterogeneity": [] if spec.get("segment_field") else ["segment_field"],
        "mechanism": [] if len(spec.get("hypotheses") or []) >= 2 else ["two rival hypotheses"],
        "predictive": [k for k in ("time_field", "prediction_design", "baseline_model") if not spec.get(k)],
        "decision": [k for k in ("actions", "utility", "fallback_action") if not spec.get(k)],
    }
    lacks["causal"], violated = causal_gaps(spec, evidence or {}, tuple(x for x in ("measurement", "temporal") if lacks[x]))
    layers = {}
    for layer in LAYERS:
        missing = lacks[layer]
        partial = layer == "causal" and not violated
        layers[layer] = {"status": "not_requested" if layer not in needed else "ready" if not missing else "conditional" if partial else "blocked", "missing": missing if layer in needed else []}
    permitted = {"descriptive": layers["descriptive"]["status"] == "ready" and not lacks["measurement"]}
    permitted |= {claim: layers[claim]["status"] == "ready" for claim in ("causal", "predictive", "decision")}
    return {"status": "compiled", "errors": [], "required_layers": needed, "layers": layers, "claim_permissions": permitted, "fingerprint": hashlib.sha256(canonical(spec).encode()).hexdigest()[:16]}


#: Containers that count together when a route is chosen.
ROUTE_KINDS = {
    "document": ("document", "text_document", "article_candidate"), "table": ("table", "workbook"), "image": ("image",), "media": ("media", "recording"), "archive": ("archive",), "data": ("data", "file"),
}
#: Routes by what an inventory mostly holds, in the order they are tried.
ROUTES = (
    ("repeated_operational_tables", lambda s: s["table"] >= 3 and s["repeated_exports"] >= 2),
    ("conversation_corpus", lambda s: s["conversations"] > 0),
    ("text_corpus", lambda s: s["document"] > max(s["table"], s["image"] + s["media"])),
    ("multimodal_evidence", lambda s: s["image"] + s["media"] > s["table"]),
    ("single_table", lambda s: s["table"] > 0),
)


def recognize_dimensions(goal: str, patterns: dict[str, list[str]]) -> list[str]:
    """Dimensions that a goal names, in the order of first mention."""
    found = {}
    for name, options in patterns.items():
        places = [m.start() for p in options for m in re.finditer(p, goal, re.IGNORECASE)]
        if places:
            found[name] = min(places)
    return sorted(found, key=found.get)


def route(goal: str, summary: dict[str, int], research: bool = False) -> dict[str, Any]:
    """The route for a one-row inventory summary, and the smallest sufficient tier."""
    held = {kind: sum(summary.get(c, 0) for c in containers) for kind, containers in ROUTE_KINDS.items()}
    name = next((n for n, fits in ROUTES if fits(held | {k: summary.get(k, 0) for k in ("repeated_exports", "conversations")})), "mixed_corpus")
    kinds = sum(n > 0 for kind, n in held.items() if kind != "data")
    files = sum(held.values())
    tier = "research" if research else "evidence" if files > 20 or kinds >= 2 or name in ("repeated_operational_tables", "multimodal_evidence") else "default"
    return {"route": name, "tier": tier, "fingerprint": hashlib.sha256(f"{goal}|{name}|{tier}".encode()).hexdigest()[:12]}


def request_errors(request: dict[str, Any]) -> list[str]:
    """Attempted, succeeded and count must agree."""
    attempted, succeeded, count = request.get("attempted"), request.get("succeeded"), request.get("request_count")
    if not isinstance(attempted, bool) or not isinstance(succeeded, bool):
        return ["attempted and succeeded must be true or false"]
    if isinstance(count, bool) or not isinstance(count, int) or count < 0:
        return ["request_count must be a count"]
    return [m for m, bad in (("a success needs an attempt", succeeded and (not attempted or count < 1)), ("no attempt means no request", not attempted and count != 0)) if bad]


def evidence_errors(refs: list[str], evidence: dict[str, str]) -> list[str]:
    """evidence: status by id."""
    return [f"unknown evidence reference: {r}" if r not in evidence else f"unverified evidence reference: {r}" for r in refs if evidence.get(r) != "verified"]


ANGLE_FIELDS = ("title", "question", "why_worthwhile", "analysis_unit", "counterexample_check", "failure_condition")


def compile_angles(question: str, candidates: list[dict[str, Any]], evidence: dict[str, str], request: dict[str, Any]) -> dict[str, Any]:
    """At most eight candidates, four of them adopted; an adoption needs a sound contract and verified evidence."""
    if not question.strip():
        raise SpecError("the decision question must be kept")
    if len(candidates) > 8 or sum(c.get("status") == "adopted" for c in candidates) > 4:
        raise SpecError("at most 8 candidates and 4 adoptions")
    wrong = request_errors(request)
    if wrong:
        raise SpecError("; ".join(wrong))
    seen: set[str] = set()
    out = []
    for c in candidates:
        errors = [f"{f} is required" for f in ("candidate_id", *ANGLE_FIELDS) if not c.get(f)]
        errors += ["candidate_id is duplicated"] if c.get("candidate_id") in seen else []
        seen.add(c.get("candidate_id"))
        refs = list(c.get("evidence_refs") or [])
        problems = evidence_errors(refs, evidence) + ([] if refs else ["evidence is required"])
        adopted = c.get("status") == "adopted" and request["succeeded"] and not errors and not problems
        out.append({"candidate_id": c.get("candidate_id"), "adopted": adopted, "contract_errors": errors, "evidence_errors": problems})
    return {"decision_question": question, "candidates": out, "adopted": [x["candidate_id"] for x in out if x["adopted"]]}


FORBIDDEN_WORDING = {"causal": r"(?i)\bcaus|\bleads? to\b|\bdue to\b|导致|造成", "predictive": r"(?i)\bwill\b|\bforecast|预计|将会", "decision": r"(?i)\bshould\b|\brecommend|建议|应当"}


def compile_findings(findings: list[dict[str, Any]], question: dict[str, Any], evidence: dict[str, str], results: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """A finding is adopted if it is complete, worded within the permissions, backed by verified evidence, and equal to a fresh result."""
    out = []
    for f in findings:
        errors = [f"{k} is required" for k in ("finding_id", "claim", "claim_type", "counterexample", "alternative") if not f.get(k)]
        allowed = question.get("claim_permissions", {})
        if not allowed.get(f.get("claim_type", ""), False):
            errors.append(f"{f.get('claim_type')} claims are not permitted")
        for kind, pattern in FORBIDDEN_WORDING.items():
            if kind != f.get("claim_type") and not allowed.get(kind, False) and re.search(pattern, f.get("claim") or ""):
                errors.append(f"the wording claims more: {kind}")
        errors += evidence_errors(list(f.get("evidence_refs") or []), evidence) or ([] if f.get("evidence_refs") else ["evidence is required"])
        stated = f.get("result")
        if stated is not None and canonical(results.get(f.get("result_id"))) != canonical(stated):
            errors.append("the stated result differs from a fresh run")
        out.append({"finding_id": f.get("finding_id"), "adopted": not errors, "errors": errors})
    return {"findings": out, "adopted": [x["finding_id"] for x in out if x["adopted"]]}


def retention(baseline: list[str], disposition: dict[str, str]) -> dict[str, Any]:
    """Every numbered baseline finding must be kept, merged or rejected with a word; none may vanish."""
    ids = [f"E0-R{i:03d}" for i in range(1, len(baseline) + 1)]
    missing = [i for i in ids if disposition.get(i) not in ("kept", "merged", "rejected")]
    return {"ids": dict(zip(ids, baseline, strict=True)), "missing": missing, "passed": not missing}


def independence_errors(earlier: list[dict[str, str]], later: list[dict[str, str]]) -> list[str]:
    """Holdout evidence may share no id, group, unit or place with what came before."""
    out = []
    for key in ("evidence_id", "group_id", "unit_id", "locator"):
        shared = {x.get(key) for x in earlier} & {x.get(key) for x in later} - {None}
        out += [f"{key} {s} is in both" for s in sorted(shared)]
    return out


def plan_batches(items: list[tuple[str, str]], size: int, done: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """Batches of (family, id) with a fingerprint; one whose fingerprint is done is reused, not run again."""
    by: dict[str, list[str]] = {}
    for family, item in sorted(items):
        by.setdefault(family, []).append(item)
    out = []
    for family, ids in by.items():
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            mark = hashlib.sha256("|".join(part).encode()).hexdigest()[:16]
            name = f"{family}-{k // size:03d}"
            out.append({"batch": name, "family": family, "ids": part, "fingerprint": mark, "status": "reused" if (done or {}).get(name) == mark else "pending"})
    return out


def compile_scope(question: str, shared: dict[str, Any], families: list[dict[str, Any]], sources: list[str], evidence: dict[str, str], request: dict[str, Any]) -> dict[str, Any]:
    """Whether a corpus may be read as one: a confirmed shared object and problem, and every source in one family or left out by name."""
    if not question.strip():
        raise SpecError("the decision question must be kept")
    errors = request_errors(request) + evidence_errors(list(shared.get("evidence_refs") or []), evidence)
    for k in ("shared_object_status", "shared_problem_status"):
        if shared.get(k, "candidate") not in ("confirmed", "candidate", "absent"):
            errors.append(f"{k} is invalid")
    confirmed = not errors and all(shared.get(k) == "confirmed" for k in ("shared_object_status", "shared_problem_status")) and bool(shared.get("evidence_refs"))
    owner: dict[str, str] = {}
    for f in families:
        for s in f.get("sources", []):
            if s in owner:
                errors.append(f"{s} lies in {owner[s]} and {f['family_id']}")
            if s not in sources:
                errors.append(f"{s} is not in the inventory")
            owner[s] = f["family_id"]
    left_out = {s for f in families for s in f.get("excluded", [])}
    unassigned = sorted(set(sources) - set(owner) - left_out)
    verdict = "one_scope" if confirmed and not unassigned and not errors else "by_family" if families and not errors else "blocked"
    return {"decision_question": question, "verdict": verdict, "unassigned": unassigned, "errors": errors}


def record_progress(state: dict[str, list[bool]], family: str, brought_new: bool) -> dict[str, Any]:
    """Append a batch's outcome; a family is stable once two batches in a row brought nothing new."""
    history = [*state.get(family, []), brought_new]
    return {"state": state | {family: history}, "stable": history[-2:] == [False, False]}


def gate(checks: dict[str, bool], required: list[str]) -> dict[str, Any]:
    """A run passes if every required check is there and holds; a check that is missing is not one that holds."""
    failed = [k for k in required if not checks.get(k, False)]
    return {"passed": not failed, "failed": failed, "missing": [k for k in required if k not in checks]}
