"""Re-verification of ledgers against measure() and plain Python, prefix matches, phrases, merges and locators against brute force."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions.predicates import SpecError
from quernstone.operators import evidence, increments, prefixes, verification
from quernstone.operators.measure import KINDS, measure

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    cell = lambda i: "n/a" if i == 150 else rng.choice([None, "", " ", "1,200", f"{rng.random() * 50:.3f}", f"{rng.randint(-9, 9)}"])
    rows = [(str(DAY + datetime.timedelta(days=i // 2)) + rng.choice(["", "T07:30:00", "T23:59:59.5"]), cell(i), rng.choice("aab"), rng.choice(["p", "q"]), i) for i in range(200)] + [("never", "1", "a", "p", 900), (None, "2", "b", "q", 901)]
    return spark.createDataFrame(rows, "t string, v string, g string, s string, i int").cache()


def specs():
    groups = {"group_field": "g", "group_a": "a", "group_b": "b"}
    condition = {"condition": {"operator": "gt", "value": 3}}
    more = {
        "count": [{}], "proportion": [condition | {"field": "i"}, condition | {"field": "v"}], "group_rate_difference": [groups | condition | {"field": "i"}], "subgroup_difference_spread": [groups | {"field": "i", "subgroup_field": "s"}],
        "difference_in_differences": [{"field": "v", "group_field": "g", "treated_value": "a", "control_value": "b", "period_field": "s", "pre_value": "p", "post_value": "q"}], "lagged_pearson": [{"x_field": "i", "y_field": "i", "lag": 1, "order": ["i"]}],
        "walk_forward_interval_mae": [{"event_field": "i", "order": ["i"]}], "rolling_origin_naive_mae": [{"field": "i"}],
    }
    for kind in KINDS:
        for m in more.get(kind, [{"field": "v", "order": ["i"]}, {"field": "i", "order": ["i"]}] if not kind.startswith("group") else [groups | {"field": "v"}, groups | {"field": "i"}]):
            yield {"kind": kind} | m


WINDOWS = [(None, None), ("2024-01-05", "2024-02-01"), ("2024-01-20T07:30:00", "2024-01-20T07:30:00"), ("2024-03-10", None), (None, "2024-01-02"), ("2030-01-01", "2030-02-01"), ("2024-02-01", "2024-01-01"), ("whenever", "2024-02-01")]


def test_shared_scan_equals_measure(spark, series):
    quick = [m for m in specs() if m["kind"] not in verification.OWN_PASS]
    findings = [{"finding_id": f"{k}-{w}", "measurement": m, "start": s, "end": e} for k, m in enumerate(quick) for w, (s, e) in enumerate(WINDOWS) if (k + w) % 3]
    got = {r.finding_id: tuple(r)[1:] for r in verification.fresh_figures(series, findings, "t").collect()}
    assert len(got) == len(findings) and len({v[4] for v in got.values()}) == 2
    rng = random.Random(1)
    for f in rng.sample(findings, 45):
        want = measure(series, f["measurement"], "t", f["start"], f["end"]).first()
        assert got[f["finding_id"]] == tuple(want), f


def test_kinds_of_their_own_pass(spark, series):
    findings = [{"finding_id": f"{m['kind']} {m.get('field')}", "measurement": m} for m in specs() if m["kind"] in verification.OWN_PASS]
    got = {r.finding_id: tuple(r)[1:] for r in verification.fresh_figures(series, findings, "t").collect() if r}
    for f in findings[:2]:
        assert got[f["finding_id"]] == tuple(measure(series, f["measurement"], "t").first())
    assert {f["finding_id"] for f in findings} == set(got) and verification.fresh_figures(series, [], "t").count() == 0
    with pytest.raises(SpecError):
        verification.fresh_figures(series, [{"finding_id": "x", "measurement": {"kind": "mode"}}], "t")


def test_a_hundred_findings_are_one_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    findings = [{"finding_id": f"{d}-{k}", "measurement": {"kind": k, "field": "o_totalprice"}, "start": str(datetime.date(1993, 1, 1) + datetime.timedelta(days=50 * d))} for d in range(25) for k in ("mean", "max", "last", "median")]
    plan = verification.fresh_figures(orders, findings, "o_orderdate")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_reverify_names_what_differs(spark, series):
    other = series.withColumn("i", F.col("i") + 1)
    m = {"kind": "max", "field": "i"}
    findings = [{"finding_id": n, "source": s, "measurement": m, "end": "2024-05-01"} for n, s in (("right", "a"), ("off", "b"), ("silent", "a"), ("bad", "a"))]
    findings[3]["measurement"] = {"kind": "mean", "field": "v"}
    findings.append({"finding_id": "when", "source": "b", "measurement": {"kind": "date_of_max", "field": "i"}, "end": "2024-05-01"})
    stated = spark.createDataFrame([("right", 199.0, None), ("off", 199.0, None), ("bad", 1.0, None), ("when", None, "2024-04-09")], "finding_id string, value double, text string")
    got = {r.finding_id: (r.verdict, r.value) for r in verification.reverify({"a": (series, "t"), "b": (other, "t")}, findings, stated).collect()}
    assert got == {"right": ("confirmed", 199.0), "off": ("differs", 200.0), "silent": ("unstated", 199.0), "bad": ("unverifiable", None), "when": ("confirmed", None)}
    with pytest.raises(SpecError):
        verification.reverify({"a": (series, "t")}, findings, stated)


def test_ledger_problems(spark):
    good = ("f1", "prediction", "c", "c", "predictive", "out_of_sample", "supported")
    rows = [good, ("f2", "causal_effect", "t", "c", "predictive", "out_of_sample", "open"), ("f3", "description", "t", "c", None, None, None), ("f4", "description", "t", " ", None, None, None), ("f4", "relationship", "t", "c", None, None, None), ("f5", *good[1:])]
    findings = spark.createDataFrame(rows, "finding_id string, claim_level string, title string, claim string, layer string, validation_type string, validation_status string")
    links = spark.createDataFrame([("f1", "e1"), ("f1", "e1"), ("f2", "e2"), ("f3", "e3"), ("f3", "e9"), ("f5", "e4")], "finding_id string, ref string")
    cards = [("e1", True, "analysis_result", "derived", "completed", "predictive", "c"), ("e2", False, "context", "direct", None, "causal", "c"), ("e3", True, "context", "direct", None, None, None), ("e4", True, "analysis_result", "derived", "failed", "causal", "d")]
    evidence = spark.createDataFrame(cards, "ref string, verified boolean, lane string, directness string, status string, layer string, claim string")
    got = {(r.finding_id, r.problem, r.ref) for r in verification.ledger_problems(findings, links, evidence, ["predictive"]).collect()}
    assert got == {
        ("f2", "the title must be the measured claim", None), ("f2", "the claim's layer is not permitted", None), ("f2", "the design is of another layer", None), ("f2", "the validation does not carry the claim", None),
        ("f2", "the validation is not supported", None), ("f2", "unverified evidence", "e2"), ("f2", "the evidence is no analysis result", "e2"), ("f2", "the result is not complete", "e2"), ("f3", "unknown evidence", "e9"),
        ("f4", "finding_id is duplicated", None), ("f4", "claim is required", None), ("f5", "the result is not complete", "e4"), ("f5", "the result is of another layer", "e4"), ("f5", "the claim is not the measured one", "e4"),
    }
    assert verification.ledger_problems(findings.limit(0), links, evidence, []).count() == 0


def brute_directory(title, directories):
    """The best of (name, directory): equal, else a prefix either way by the length shared, else none."""
    found = sorted((-3 if n == title else -2, -min(len(n), len(title)), n, d) for n, d in directories if n.startswith(title) or title.startswith(n))
    if not found:
        return None, "unmatched"
    best = found[0]
    if sum(n == best[2] for n, _ in directories) > 1:
        return None, "ambiguous"
    return best[3], "exact_title" if best[0] == -3 else "prefix_title"


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
    return [(k, rng.choice("xyz"), word(7)) for k in range(90)], [(f"d{k}", rng.choice("xy"), word(6)) for k in range(45)] + [("long", "x", "ab" * 120)]


def test_prefix_matches_equal_brute_force(spark, names):
    titles, own = names
    articles = spark.createDataFrame([*titles, (99, "x", None)], "a int, root string, title string")
    directories = spark.createDataFrame([*own, ("none", "x", None)], "d string, root string, name string")
    got = prefixes.match_directories(articles, directories, ["root"], "a", "title", "d", "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    within = lambda root: [(n, d) for d, r, n in own if r == root]
    assert {r.a: (r.d, r.match) for r in got.collect()} == {a: brute_directory(t, within(root)) for a, root, t in titles} | {99: (None, "unmatched")}
    covers = prefixes.match_covers(articles, directories, ["root"], "a", "title", "d", "name")
    want = {}
    for a, root, t in titles:
        found = [d for n, d in within(root) if n.startswith(t) or t.startswith(n)]
        want[a] = (found[0] if len(found) == 1 else None, len(found))
    assert {r.a: (r.d, r.candidates) for r in covers.collect()} == want | {99: (None, 0)}
    assert {m for _, m in map(lambda x: brute_directory(x[2], within(x[1])), titles)} == {"unmatched", "ambiguous", "exact_title", "prefix_title"}


@pytest.mark.parametrize("size", [7, 200_000])
def test_phrases_equal_contains(spark, monkeypatch, size):
    monkeypatch.setattr(prefixes, "SLICE", size)
    rng = random.Random(2)
    texts = [(k, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(60, None), (61, "ab" * 30_000)]
    phrases = [(k, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 4)))) for k in range(40)] + [(40, None), (41, "aba"), (42, "ababa")]
    got = prefixes.contained_phrases(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame(phrases, "p int, w string"), "p", "w")
    times = lambda t, w: sum(t.startswith(w, i) for i in range(len(t)))
    want = {(k, p, times(t, w), t.index(w)) for k, t in texts for p, w in phrases if t and w and w in t}
    rows = list(map(tuple, got.collect()))
    assert set(rows) == want and len(rows) == len(want)
    assert prefixes.contained_phrases(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([], "p int, w string"), "p", "w").count() == 0


def test_coverage_review(spark):
    items = spark.createDataFrame([(1, "l", " a "), (2, "", "a"), (3, "l", None), (4, "l", "zz")], "position int, source_locator string, baseline_text string")
    got = {r.position: r.problem for r in prefixes.coverage_review(items, spark.createDataFrame([("a",), (None,), ("",)], "text string")).collect()}
    assert got == {1: None, 2: "incomplete_item", 3: "incomplete_item", 4: "absent_from_baseline"}


SOURCES = {
    "j": '\ufeff{"a": {"b/c": [1, {"d": "x"}], "~": null}, "n": 1.5}', "t": "one\r\ntwo  words\nthree\n", "c": 'x,y\r\n1,"a\nb"\r\n2,c\r\n', "bad": "{", "empty": "",
}
CARD = {"claim": "c", "unit_id": "u", "independence_group": "g", "family_id": "f", "lane": "l", "directness": "direct", "verified": True, "pointer": None, "expected": None, "first": None, "last": None, "quote": None, "row": None}
KINDS_OF_CARD = "evidence_id string, source string, source_sha256 string, kind string, claim string, unit_id string, independence_group string, family_id string, lane string, directness string, verified boolean, pointer string, expected string, first long, last long, quote string, row long"
PLACES = [
    ("j", {"kind": "json_pointer", "pointer": "/a/b~1c/1/d", "expected": '"x"'}, []), ("j", {"kind": "json_pointer", "pointer": "/a/b~1c/0"}, []), ("j", {"kind": "json_pointer", "pointer": "/a/~0", "expected": "null"}, []),
    ("j", {"kind": "json_pointer", "pointer": "/a/b~1c/2"}, ["locator_unresolvable"]), ("j", {"kind": "json_pointer", "pointer": "/n", "expected": "2"}, ["locator_expected_mismatch"]), ("j", {"kind": "json_pointer"}, []),
    ("bad", {"kind": "json_pointer", "pointer": ""}, ["locator_unresolvable"]), ("t", {"kind": "line_range", "first": 1, "last": 3, "quote": "one two words"}, []), ("t", {"kind": "line_range", "first": 2, "last": 2, "quote": "three"}, ["locator_quote_mismatch"]),
    ("t", {"kind": "line_range", "first": 2, "last": 4}, ["locator_line_range_invalid"]), ("t", {"kind": "line_range", "first": 0, "last": 1}, ["locator_line_range_invalid"]), ("t", {"kind": "line_range", "first": 1}, ["locator_unresolvable"]),
    ("t", {"kind": "line_range", "first": 3, "last": 3}, []), ("empty", {"kind": "line_range", "first": 1, "last": 1}, ["locator_line_range_invalid"]), ("c", {"kind": "csv_row", "row": 2}, []), ("c", {"kind": "csv_row", "row": 3}, ["locator_csv_row_invalid"]),
    ("c", {"kind": "csv_row"}, ["locator_unresolvable"]), ("bytes", {"kind": "csv_row", "row": 1}, ["locator_unresolvable"]), ("bytes", {"kind": "image"}, []), ("t", {"kind": None}, ["locator_missing"]), ("t", {"kind": "page"}, ["locator_type_invalid"]),
    ("gone", {"kind": "image"}, ["source_file_missing"]), ("t", {"kind": "image", "claim": " ", "directness": "rumour"}, ["claim_missing", "directness_invalid"]), ("t", {"kind": "image", "source_sha256": "ab"}, ["source_sha256_missing_or_invalid"]),
    ("t", {"kind": "image", "source_sha256": "AB" * 32}, ["source_sha256_mismatch"]), ("t", {"kind": "page", "verified": False}, []),
]


def test_cards_against_sources(spark):
    contents = {k: v.encode() for k, v in SOURCES.items()} | {"bytes": b"\xff\xfe\x00"}
    cards = [CARD | {"evidence_id": f"e{k}", "source": s, "source_sha256": hashlib.sha256(contents.get(s, b"")).hexdigest()} | place for k, (s, place, _) in enumerate(PLACES)]
    cards += [cards[0] | {"evidence_id": "twice"}] * 2 + [cards[0] | {"evidence_id": None}]
    frame = spark.createDataFrame([tuple(c[n.split()[0]] for n in KINDS_OF_CARD.split(", ")) for c in cards], KINDS_OF_CARD)
    got = sorted((r.evidence_id or "", r.error) for r in evidence.card_errors(frame, spark.createDataFrame(list(contents.items()), "source string, content binary")).collect())
    assert got == sorted([(f"e{k}", e) for k, (_, _, errors) in enumerate(PLACES) for e in errors] + [("twice", "id_duplicated"), ("", "id_missing")])


def test_prefix_joins_are_shuffled(spark):
    """Expanded names are many times what Spark expects of them, so none is broadcast, however small they look."""
    names = spark.createDataFrame([("k", f"d{n}", "abcdefgh"[:n]) for n in range(1, 9)], "key string, dir string, name string").repartition(2)
    titles = spark.createDataFrame([("k", 1, "abcdefghij"), ("k", 2, "abc"), ("k", 3, "x")], "key string, id long, title string").repartition(2)
    for match, want in ((prefixes.match_directories, {(1, "d8", "prefix_title"), (2, "d3", "exact_title"), (3, None, "unmatched")}), (prefixes.match_covers, {(1, None, 8), (2, None, 8), (3, None, 0)})):
        found = match(titles, names, ["key"], "id", "title", "dir", "name")
        assert {tuple(r) for r in found.collect()} == want
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_cards_read_each_source_once(spark, tmp_path):
    """Nodes have one spelling, places are met once, and the sources' content is scanned and shuffled once for all kinds of place."""
    contents = [("j", b'{"a": ["x", {"b~c/d": 2}], "": {"0": []}}'), ("t", "one\ntwo\u2028three".encode())]
    spark.createDataFrame(contents, "source string, content binary").write.parquet(str(tmp_path / "sources"))
    spots = {"": True, "/a/0": True, "/a/00": False, "/a/-1": False, "/a/2": False, "/a/1/b~0c~1d": True, "/a/1/b~c~1d": False, "a": False, "/": True, "//0": True, "/a/0/0": False, "/a/\u0660": False}
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in contents}
    cards = [CARD | {"evidence_id": at, "source": "j", "source_sha256": sha["j"], "kind": "json_pointer", "pointer": at} for at in spots]
    cards = [c | {"evidence_id": f"n {c['evidence_id']}"} for c in cards] + [CARD | {"evidence_id": f"l{a}{b}", "source": "t", "source_sha256": sha["t"], "kind": "line_range", "first": a, "last": b, "quote": q} for a, b, q in ((1, 2, "eto ne"), (2, 3, "two three"), (1, 4, "o"), (1, 1, "two"), (3, 2**40, "o"))]
    frame = spark.createDataFrame([tuple(c[n.split()[0]] for n in KINDS_OF_CARD.split(", ")) for c in cards], KINDS_OF_CARD)
    frame.write.parquet(str(tmp_path / "cards"))
    found = evidence.card_errors(spark.read.parquet(str(tmp_path / "cards")), spark.read.parquet(str(tmp_path / "sources")))
    want = [(f"n {at}", "locator_unresolvable") for at, there in spots.items() if not there] + [("l14", "locator_line_range_invalid"), ("l11", "locator_quote_mismatch"), ("l3" + str(2**40), "locator_line_range_invalid"), ("l12", "locator_quote_mismatch")]
    assert sorted((r.evidence_id, r.error) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # a scan of the sources is told by their column
    assert sum("FileScan" in line and "content" in line for line in plan.splitlines()) == 1 and plan.count("FileScan") == 3


def test_bindings_against_the_plan(spark):
    plan = {"target": '"t"', "outcome_field": '"v"', "planned_method": '"m"', "validation": "1"}
    targets = spark.createDataFrame([("predictive", k, v) for k, v in plan.items()], "layer string, field string, value string")
    stated = {"target": '"t"', "outcome_field": '"w"', "method": '"m"', "validation_design": "2", "horizon": "3"}
    values = spark.createDataFrame([("e", k, v) for k, v in stated.items()], "evidence_id string, field string, value string")
    bindings = spark.createDataFrame([("e", "predictive"), ("x", "causal"), ("y", "predictive")], "evidence_id string, layer string")
    got = {tuple(r) for r in evidence.binding_mismatches(bindings, values, targets).collect()}
    assert got == {("e", "outcome_field"), ("e", "validation_design"), ("e", "horizon"), ("x", "analysis_target"), *(("y", f) for f in ("target", "outcome_field", "method", "validation_design"))}


def test_adequacy_and_shared_evidence(spark):
    whole = [("b", k, "r1" if k == "evidence_ref" else "text") for k in increments.CAPABILITIES]
    entries = spark.createDataFrame([*whole, *(("c", k, "r2" if k == "evidence_ref" else v) for _, k, v in whole), ("d", "decision", " ")], "baseline_id string, kind string, value string")
    cards = spark.createDataFrame([("r1", True), ("r2", False)], "ref string, verified boolean")
    got = {r.baseline_id: (r.adequate, r.mode, r.evidence_present, r.decision_present) for r in increments.adequacy(entries, cards).collect()}
    assert got == {"b": (True, "adversarial_augmentation", True, True), "c": (False, "full_discovery", False, True), "d": (False, "full_discovery", False, False)}
    references = spark.createDataFrame([("x", "generation", "g1"), ("x", "holdout", "h1"), ("y", "holdout", "h2"), ("z", "holdout", "b1"), ("z", "generation", "h2")], "candidate_id string, role string, ref string")
    known = spark.createDataFrame([("g1", "G", "u1", None, None), ("h1", "G", "u2", "AA", "{}"), ("h2", None, "", "aa", "{}"), ("b1", "B", "u9", "aa", "{}")], "ref string, independence_group string, unit_id string, source_sha256 string, locator string")
    shared = increments.shared_evidence(references, spark.createDataFrame([("b1",)], "ref string"), known)
    place = "aa:{}"
    assert {tuple(r) for r in shared.collect()} == {("x", "group", "G"), ("x", "place", place), ("y", "place", place), ("z", "evidence", "b1"), ("z", "group", "B"), ("z", "unit", "u9"), ("z", "place", place)}


def brute_merge(b, o, t):
    if b is None and (o is None or t is None):
        return "added", o or t
    if o == t:
        return ("unchanged" if o == b else "removed" if o is None else "added" if b is None else "both"), o
    if t == b or o == b:
        side, name = (o, "ours") if t == b else (t, "theirs")
        return ("removed" if side is None else name), side
    return "conflict", None


def test_merge_and_rebase(spark):
    values = [None, "p", "q", "r"]
    cases = [(f"{b}{o}{t}", b, o, t) for b in values for o in values for t in values if b or o or t]
    version = lambda k: spark.createDataFrame([(c[0], c[k]) for c in cases if c[k]], "key string, v string")
    merged = increments.merge_versions(version(1), version(2), version(3), "key", ["v"])
    assert {r.key: (r.state, r.v) for r in merged.collect()} == {k: brute_merge(b, o, t) for k, b, o, t in cases}
    state = {"same": "unchanged", "new": "added", "gone": "removed", "mine": "ours", "fight": "conflict"}
    merged = spark.createDataFrame(list(state.items()), "key string, state string")
    rests = [("a", "same", False), ("b", "gone", False), ("c", "a", True), ("c", "new", False), ("d", "b", True), ("e", "d", True), ("f", "mine", False), ("g", "f", True), ("h", "g", True), ("h", "e", True), ("i", "nothing", False), ("j", "nobody", True), ("k", "l", True), ("l", "k", True), ("l", "fight", False)]
    ids = spark.createDataFrame([(x,) for x in "abcdefghijklm"], "increment_id string")
    got = {r.increment_id: r.outcome for r in increments.rebase(ids, spark.createDataFrame(rests, "increment_id string, on string, is_increment boolean"), merged).collect()}
    assert got == dict.fromkeys("acm", "kept") | dict.fromkeys("fgkl", "reopened") | dict.fromkeys("bdehij", "dropped")


def test_assess(spark):
    good = {"reviewer_pass": "r", "rationale": "because", "structure_status": "distinct", "prediction_status": "divergent", "novelty_status": "new_to_e0", "mechanism_test_status": "direct", "holdout_status": "supports_e1", "decision_status": "changes"}
    reviews = {
        "valid": [good], "test": [good | {"holdout_status": "mixed"}], "none": [], "twice": [good, good], "own": [good | {"reviewer_pass": "gen"}], "odd": [good | {"novelty_status": "novel"}], "mute": [good | {"rationale": " "}],
        "same": [good | {"structure_status": "same"}], "flat": [good | {"decision_status": "no_change"}], "lost": [good | {"holdout_status": "supports_e0"}], "said": [good], "told": [good], "bare": [good],
    }
    candidates = [(k, k != "bare", "gen", "Known: Claim" if k == "said" else k, "known prediction!" if k == "told" else k) for k in reviews]
    rows = [(k, *r.values()) for k, rs in reviews.items() for r in rs]
    baseline = spark.createDataFrame([("claim", "known claim"), ("prediction", "Known ＰＲＥＤＩＣＴＩＯＮ"), ("claim", None)], "kind string, text string")
    got = increments.assess(spark.createDataFrame(candidates, "candidate_id string, eligible boolean, generation_pass string, claim string, e1_prediction string"), spark.createDataFrame(rows, "candidate_id string, " + ", ".join(f"{k} string" for k in good)), baseline)
    want = {"valid": "validated_increment", "test": "testable_increment", "none": "pending_review", "bare": "rejected_mechanical"} | dict.fromkeys(("twice", "own", "odd", "mute"), "invalid_review") | dict.fromkeys(("same", "flat", "lost", "said", "told"), "no_increment")
    assert {r.candidate_id: r.outcome for r in got.collect()} == want


def test_a_sum_is_the_same_in_any_order(spark):
    """A million cells of two decimals each: the order of a plain sum shows in its fourth digit, and a verdict with it."""
    df = spark.range(1_000_000).select(F.lit("2024-01-02").alias("day"), ((F.col("id") * 7919 % 50_000_000) / 100).alias("v"))
    (want,) = df.agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double")).first()
    finding = {"finding_id": "s", "source": "t", "measurement": {"kind": "sum", "field": "v"}, "start": "2024-01-01", "end": "2024-01-03"}
    stated = spark.createDataFrame([("s", want, None)], "finding_id string, value double, text string")
    for rows in (df.repartition(7), df.orderBy(F.desc("v"))):
        got = verification.reverify({"t": (rows, "day")}, [finding], stated, tolerance=1e-6).first()
        assert (got.value, got.verdict) == (want, "confirmed")


def test_a_sum_of_other_doubles_is_their_plain_sum(spark):
    from quernstone.functions.types import exact_sum

    sums = spark.createDataFrame([(1, 1e-12), (1, 2e-12), (2, 1e300), (2, 1e300), (3, None)], "k int, v double").groupBy("k").agg(exact_sum(F.col("v")).alias("s"))
    assert {r.k: r.s for r in sums.collect()} == {1: 3e-12, 2: 2e300, 3: None}
