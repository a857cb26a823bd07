"""Incremental discovery over versioned tables: what a baseline offers, what shares its evidence, and what a new baseline leaves of each increment.

Ledgers are tables of entries with a fingerprint of their contents. A merge holds two
later versions against their common base, entry by entry; an increment is kept,
reopened or dropped by what became of the baseline entries that it rests on, and so
are those that rest on it, however many steps away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..session import discard, materialize

#: Kinds of baseline entry that a first pass must hold, and the capability that each brings.
CAPABILITIES = {
    "core_problem": "core_problem_specific", "mechanism": "mechanism_present", "competing_explanation": "competing_explanation_present", "prediction": "prediction_present",
    "retained_finding": "retained_findings_present", "decision": "decision_present", "evidence_ref": "evidence_present",
}


def adequacy(entries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per baseline each capability, adequate, and mode: adversarial_augmentation if all are there, else full_discovery.

    entries: baseline_id, kind, value; evidence: ref, verified. Evidence counts if every reference is to a verified card.
    """
    cards = evidence.select(F.col("ref").alias("value"), F.col("verified").alias("_verified"))
    worded = entries.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    checked = worded.join(cards.dropDuplicates(["value"]), "value", "left")
    has = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    is_ref = F.col("kind") == "evidence_ref"
    sound = has("evidence_ref") & ~F.coalesce(F.bool_or(is_ref & ~F.coalesce("_verified", F.lit(False))), F.lit(False))
    figures = [(sound if kind == "evidence_ref" else has(kind)).alias(name) for kind, name in CAPABILITIES.items()]
    found = entries.select("baseline_id").distinct().join(checked.groupBy("baseline_id").agg(*figures), "baseline_id", "left").na.fill(False)
    adequate = F.array_min(F.array(*CAPABILITIES.values()))
    return found.withColumn("adequate", adequate).withColumn("mode", F.when(F.col("adequate"), "adversarial_augmentation").otherwise("full_discovery"))


def shared_evidence(references: DataFrame, baseline_refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate_id, kind, value): evidence, independence groups, units or places that a candidate's holdout shares with its generation or the baseline.

    references: candidate_id, role (generation or holdout), ref; baseline_refs: ref; evidence: ref, independence_group,
    unit_id, source_sha256, locator (canonical JSON). All of it by equality.
    """
    place = F.when(F.col("source_sha256").isNotNull() & F.col("locator").isNotNull(), F.concat_ws(":", F.lower("source_sha256"), F.col("locator")))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    names = evidence.select("ref", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("group", filled("independence_group")), ("unit", filled("unit_id")), ("place", place))))).alias("x")).select("ref", "x.*").filter("value IS NOT NULL")

    def identities(refs: DataFrame, *keys: str) -> DataFrame:
        own = refs.select(*keys, F.lit("evidence").alias("kind"), F.col("ref").alias("value"))
        return own.unionByName(refs.select(*keys, "ref").join(names, "ref").select(*keys, "kind", "value")).distinct()

    held = identities(references.filter("role = 'holdout'"), "candidate_id")
    made = identities(references.filter("role = 'generation'"), "candidate_id")
    before = identities(baseline_refs)
    return held.join(made, ["candidate_id", "kind", "value"], "left_semi").union(held.join(before, ["kind", "value"], "left_semi").select(*held.columns)).distinct()


def merge_versions(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, state, and columns of the merged entry: a three-way merge by fingerprint.

    state: unchanged, ours, theirs (that side alone changed it), both (alike), added, removed, or conflict: changed
    differently on both sides, or changed on one and removed on the other. A conflict has no merged entry; it is a row.
    """
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    side = lambda df, name: df.select(key, F.struct(mark.alias("mark"), *columns).alias(name))
    met = side(base, "_b").join(side(ours, "_o"), key, "full_outer").join(side(theirs, "_t"), key, "full_outer")
    b, o, t = (F.col(f"{x}.mark") for x in ("_b", "_o", "_t"))
    same = lambda x, y: x.eqNullSafe(y)
    gone = lambda x: F.when(x.isNull(), "removed")
    state = (
        F.when(b.isNull() & (o.isNull() | t.isNull()), "added").when(same(o, b) & same(t, b), "unchanged").when(same(o, t), F.coalesce(gone(o), F.when(b.isNull(), "added"), F.lit("both")))
        .when(same(t, b), F.coalesce(gone(o), F.lit("ours"))).when(same(o, b), F.coalesce(gone(t), F.lit("theirs"))).otherwise("conflict")
    )
    merged = F.when(F.col("state").isin("conflict", "removed"), F.lit(None)).when(F.col("state") == "theirs", F.col("_t")).otherwise(F.coalesce("_o", "_t"))
    return met.withColumn("state", state).withColumn("_m", merged).select(key, "state", *(F.col("_m")[c].alias(c) for c in columns))


def rebase(increments: DataFrame, rests_on: DataFrame, merged: DataFrame) -> DataFrame:
    """increment_id, outcome (kept, reopened or dropped) and because (the key that decides, or null) after the baseline has changed.

    rests_on: increment_id, on (a baseline key or another increment's id), is_increment; merged: key, state of each
    baseline entry. What a removed or unknown entry bore is dropped, what a changed or conflicting one bore is reopened;
    an increment is no better off than those it rests on. Levels are passed on step by step until nothing changes, each
    step an equi-join, so that chains and cycles of any shape end.
    """
    grade = F.when(F.col("state").isNull() | (F.col("state") == "removed"), 2).when(F.col("state").isin("ours", "theirs", "both", "conflict"), 1).otherwise(0)
    direct = rests_on.filter("NOT is_increment").select("increment_id", F.col("on").alias("key")).join(merged.select("key", "state"), "key", "left")
    own = direct.groupBy("increment_id").agg(F.max(F.struct(grade.alias("grade"), F.col("key").alias("because"))).alias("worst"))
    now = increments.select("increment_id").distinct().join(own, "increment_id", "left")
    now = materialize(now.select("increment_id", F.coalesce("worst.grade", F.lit(0)).alias("grade"), F.when(F.col("worst.grade") > 0, F.col("worst.because")).alias("because")), "rebase")
    links = rests_on.filter("is_increment").select("increment_id", F.col("on").alias("_on")).distinct()
    columns = ["increment_id", "grade", "because"]
    again = True
    while again:
        borne = links.join(now.select(F.col("increment_id").alias("_on"), F.col("grade").alias("_g")), "_on", "left")
        # an increment that doesn't exist can't bear anything
        worst = borne.groupBy("increment_id").agg(F.max(F.struct(F.coalesce("_g", F.lit(2)).alias("g"), "_on")).alias("w"))
        raised = F.coalesce(F.col("w.g") > F.col("grade"), F.lit(False))
        step = now.select(*columns).join(worst, "increment_id", "left").select("increment_id", F.greatest("grade", "w.g").alias("grade"), F.when(raised, F.col("w._on")).otherwise(F.col("because")).alias("because"), raised.alias("raised"))
        step = materialize(step, "rebase")
        again = not step.filter("raised").isEmpty()
        discard(now)
        now = step
    outcome = F.when(F.col("grade") == 2, "dropped").when(F.col("grade") == 1, "reopened").otherwise("kept")
    return now.select("increment_id", outcome.alias("outcome"), "because")


#: What a review may say of an increment, and which of it an increment needs.
REVIEW_STATES = {
    "structure_status": ("distinct", "same", "unresolved"), "prediction_status": ("divergent", "same", "untestable"), "novelty_status": ("new_to_e0", "already_in_e0", "overlaps_e0", "unresolved"),
    "mechanism_test_status": ("direct", "partial", "tangential", "unsafe"), "holdout_status": ("supports_e1", "supports_e0", "mixed", "not_tested"), "decision_status": ("changes", "refines", "no_change"),
}
NEEDED = {"structure_status": ("distinct",), "prediction_status": ("divergent",), "novelty_status": ("new_to_e0",), "mechanism_test_status": ("direct",), "decision_status": ("changes", "refines")}


def assess(candidates: DataFrame, reviews: DataFrame, baseline: DataFrame) -> DataFrame:
    """candidate_id and outcome: rejected_mechanical, pending_review, invalid_review, no_increment, testable_increment or validated_increment.

    candidates: candidate_id, eligible, generation_pass, claim, e1_prediction; reviews: candidate_id, reviewer_pass,
    rationale and the REVIEW_STATES, holdout_status from a measured experiment; baseline: kind (claim or prediction) and
    text of an external baseline, which no increment may repeat. A candidate reviewed twice has no valid review.
    """
    said = lambda kind: baseline.filter(F.col("kind") == kind).select(normalize_title(F.col("text")).alias(f"_{kind}")).filter(f"_{kind} <> ''").distinct().withColumn(f"_said_{kind}", F.lit(True))
    own = candidates.withColumn("_claim", normalize_title(F.col("claim"))).withColumn("_prediction", normalize_title(F.col("e1_prediction")))
    own = own.join(said("claim"), "_claim", "left").join(said("prediction"), "_prediction", "left")
    told = reviews.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_times"), *(F.any_value(c).alias(c) for c in ("reviewer_pass", "rationale", *REVIEW_STATES)))
    met = own.join(told, "candidate_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    broken = (F.col("_times") > 1) | blank(F.col("reviewer_pass")) | (F.col("reviewer_pass") == F.col("generation_pass")) | blank(F.col("rationale"))
    for name, states in REVIEW_STATES.items():
        broken |= ~F.coalesce(F.col(name).isin(*states), F.lit(False))
    lacking = F.coalesce("_said_claim", "_said_prediction", F.lit(False)) | (F.col("holdout_status") == "supports_e0")
    for name, states in NEEDED.items():
        lacking |= ~F.col(name).isin(*states)
    outcome = (
        F.when(~F.coalesce("eligible", F.lit(False)), "rejected_mechanical").when(F.col("_times").isNull(), "pending_review").when(F.coalesce(broken, F.lit(True)), "invalid_review")
        .when(lacking, "no_increment").when(F.col("holdout_status") == "supports_e1", "validated_increment").otherwise("testable_increment")
    )
    return met.select("candidate_id", outcome.alias("outcome"))
