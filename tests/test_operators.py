"""Operators on hand-made tables, where gates, ties and missing values matter."""

from __future__ import annotations

import datetime
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import corpus, inference, matching, operational, sampling, series, table
from quernstone.operators import measure as m
from quernstone.operators import text as ot


def test_profile_of_typed_columns_is_that_of_their_texts(spark, monkeypatch):
    """Whole numbers, doubles and days are counted as they are, with the figures of their texts; only texts are read for numbers."""
    day, inf = datetime.date(2024, 1, 2), float("inf")
    rows = [(1, 2**53 + 1, 0.0, day, "1,5", True), (2, None, -0.0, day, " ", False), (2, -(2**63), float("nan"), None, None, True), (None, 0, inf, day.replace(year=2020), "nan", None), (5, 7, 1e-9, day, "1e3", True), (5, 7, 1e20, day, "0.10", True), (5, 7, None, day, "0.1", True)]
    df = spark.createDataFrame(rows, "a int, b long, c double, d date, e string, f boolean")
    texts = {tuple(r) for r in table.profile(table.as_text(df)).collect()}
    read = []
    monkeypatch.setattr(table, "lenient_number", lambda c, real=table.lenient_number: read.append(c) or real(c))
    assert {tuple(r) for r in table.profile(df).collect()} == texts
    table.profile(df.select("a", "b", "c", "d"))
    assert len(read) == 1


def test_quantiles_find_their_range_by_halving(spark):
    """The range of a value is the number of cuts below it, also where cuts are equal; no array is searched through for a row."""
    for values in ([(float(v), 1) for v in range(1000)], [(0.0, 500), (1.0, 3), (2.5, 400)], [(4.0, 1)], [(-1.0, 2), (8.0, 2)]):
        df = spark.createDataFrame([("g", *v) for v in values], "g string, v double, n long")
        found = series.exact_quantiles(df, ["g"], "v", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
        assert tuple(found.first())[1:] == pytest.approx(np.quantile(np.repeat(*zip(*values, strict=True)), [0.25, 0.5, 0.75]))
        assert "size(filter(_cuts" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profile_tells_missing_from_zero(spark):
    df = spark.createDataFrame([("0",), ("",), (None,), ("3",), ("x",)], "a string")
    r = table.profile(df).first()
    assert (r.row_count, r.missing_count, r.zero_count, r.valid_count, r.unique_non_missing_count, r.inferred_type) == (5, 2, 1, 2, 3, "mixed_or_text")


def test_grouped_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (" ", "2")], "g string, v string")
    rows = {r.g: r for r in table.grouped(df, ["g"], ["v"]).collect()}
    assert rows["a"].sum is None and rows["a"].missing_or_invalid_count == 2 and rows["__MISSING__"].sum == 2.0


def test_anomalies_need_values_and_spread(spark):
    with pytest.raises(ValueError):
        table.robust_anomalies(spark.createDataFrame([("1",)] * 4, "v string"), "v", 3.5, [])
    assert table.robust_anomalies(spark.createDataFrame([("1",)] * 9 + [("5",)], "v string"), "v", 3.5, []).count() == 0


def test_change_point_takes_the_earliest_of_ties(spark):
    rows = [(f"2024-01-{d:02d}", str(float(d > 4)), d) for d in range(1, 9)]
    r = table.change_point(spark.createDataFrame(rows, "d string, v string, o int"), "d", "v", 2, ["o"]).first()
    assert (r.before_count, str(r.split_before)) == (4, "2024-01-05")


def test_ordinals_and_running_sums(spark):
    random.seed(1)
    rows = [(i, random.randint(0, 9), random.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, bucket int, v double").withColumn("k", F.col("bucket") * 1000 + F.col("i"))
    out = series.running(series.with_ordinal(df, ["k"], F.col("bucket")), ["k"], F.col("bucket"), {"s": ("sum", F.col("v")), "mx": ("max", F.col("v"))}).orderBy("k").collect()
    total, top = 0.0, 0.0
    for n, r in enumerate(out):
        total, top = total + r.v, max(top, r.v)
        assert r.ordinal == n and math.isclose(r.s, total) and r.mx == top


FACTS = "business_date string, platform string, orders double, paid_amount double, refund_amount double, promo_spend double, units double, after_sale_orders double"


def test_decomposition_reconciles_and_absence_is_not_zero(spark):
    rows = [("2024-01-01", "A", 10.0, 100.0, None, 0.0, 10.0, 0.0), ("2024-01-02", "A", 5.0, 80.0, 4.0, None, 5.0, 1.0), ("2024-02-01", "A", 20.0, 300.0, None, None, 9.0, 0.0), ("2024-01-01", "B", 1.0, 9.0, None, None, 1.0, 0.0)]
    daily = operational.aggregate_daily(spark.createDataFrame(rows, FACTS))
    periods = [operational.Period("p1", "2024-01-01", "2024-01-31"), operational.Period("p2", "2024-02-01", "2024-02-28")]
    summary = operational.summarize(daily, periods)
    by = {r.platform: r for r in operational.compare_periods(summary, "p1", "p2").collect()}
    assert by["B"].comparison_status == "not_comparable_missing_period" and by["B"].actual_change is None
    assert by["A"].actual_change == 120.0 and abs(by["A"].reconciliation_difference) < 1e-6
    assert math.isclose(by["A"].volume_effect + by["A"].paid_per_order_effect, 120.0)
    total = {(r.period, r.platform): r for r in summary.collect()}
    assert total["p1", operational.ALL].paid_amount == 189.0 and total["p2", "A"].refund_amount is None
    assert operational.check_periods([periods[0], operational.Period("x", "2024-01-31", "2024-02-02")]) == ["overlapping_periods:p1:x"]
    assert [p.start for p in operational.midpoint_periods(daily)] == ["2024-01-01", "2024-01-02"]


def test_fact_errors_and_gate(spark):
    rows = [(None, "A", 1.0, -5.0, 0.0, 0.0, 0.0, 0.0), ("2024-01-01", " ", 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    errors = operational.fact_errors(spark.createDataFrame(rows, FACTS))
    assert {r.error: r.n for r in errors.collect()} == {"missing_required": 2, "negative_paid_amount": 1}
    assert operational.quality_gate(errors, errors) == "fail"


def test_movements(spark):
    rows = [("e", "A", "p1", 5.0), ("e", "A", "p2", 9.0), ("f", "A", "p1", 1.0), ("g", "A", "p2", 1.0), ("", "A", "p1", 1.0), ("z", "A", "p1", 0.0), ("z", "A", "p2", 4.0)]
    by = {r.entity_id: r for r in operational.entity_movements(spark.createDataFrame(rows, "entity_id string, platform string, period string, paid_amount double"), "p1", "p2").collect()}
    assert by["e"].paid_amount_change == 4.0 and by["f"].status == "not_observed_after" and by["g"].status == "not_observed_before" and by["z"].paid_amount_change is None and "" not in by


EVENTS = [("2024-01-01", "1", "a"), ("2024-01-02", "4", "b"), ("2024-01-03", "2", "a"), ("2024-01-04", "x", "b")]


def test_measurements_report_problems_as_status(spark):
    df = spark.createDataFrame(EVENTS, "t string, v string, g string")
    assert m.measure(df, {"kind": "mean", "field": "v"}, "t").first().status == "unverifiable"
    r = m.measure(df, {"kind": "max_drawdown_pct", "field": "v"}, "t", "2024-01-01", "2024-01-03").first()
    assert (r.value, r.n, r.status) == (-50.0, 3, "completed")
    assert m.measure(df, {"kind": "date_of_max", "field": "v"}, "t", "2024-01-01", "2024-01-03").first().text == "2024-01-02"
    assert m.measure(df, {"kind": "sum", "field": "v"}, "t", "2030-01-01", "2030-01-02").first().status == "unverifiable"
    constant = spark.createDataFrame([(f"2024-01-0{i}", "1", str(i)) for i in range(1, 6)], "t string, x string, y string")
    assert m.measure(constant, {"kind": "lagged_pearson", "x_field": "x", "y_field": "y"}, "t").first().status == "unverifiable"
    with pytest.raises(m.SpecError):
        m.measure(df, {"kind": "mode"}, "t")


def test_measure_kinds_are_complete():
    assert len(m.KINDS) == 24


def test_difference_in_differences_needs_order(spark):
    rows = [("2024-01-01", "t", "pre", "1"), ("2024-01-02", "c", "pre", "2"), ("2024-01-03", "t", "post", "5"), ("2024-01-04", "c", "post", "3")]
    spec = {"kind": "difference_in_differences", "field": "v", "group_field": "g", "period_field": "p", "treated_value": "t", "control_value": "c", "pre_value": "pre", "post_value": "post"}
    assert m.measure(spark.createDataFrame(rows, "t string, g string, p string, v string"), spec, "t").first().value == 3.0
    rows[0] = ("2024-01-09", "t", "pre", "1")
    assert m.measure(spark.createDataFrame(rows, "t string, g string, p string, v string"), spec, "t").first().status == "unverifiable"


def test_forecasts_match_a_plain_refit(spark):
    import datetime

    random.seed(3)
    values = [random.random() * 10 + i for i in range(24)]
    df = spark.createDataFrame([(datetime.date(2024, 1, 1) + datetime.timedelta(days=i), v) for i, v in enumerate(values)], "at date, value double")
    models = [inference.Model("a", "last_observation"), inference.Model("b", "rolling_mean", 3), inference.Model("c", "linear_trend"), inference.Model("d", "seasonal_naive", 4)]
    got = {r.origin: r for r in inference.forecasts(df, models, 2, 4).collect()}
    assert sorted(got) == list(range(3, 22))
    for o, r in got.items():
        h = values[: o + 1]
        mx, my = o / 2, sum(h) / len(h)
        slope = sum((i - mx) * (v - my) for i, v in enumerate(h)) / sum((i - mx) ** 2 for i in range(len(h)))
        assert r.a == h[-1] and math.isclose(r.b, sum(h[-3:]) / 3) and math.isclose(r.c, my + slope * (o + 2 - mx), rel_tol=1e-9) and r.d == values[o - 2] and r.observed == values[o + 2]


def test_block_bootstrap_matches_resampling(spark):
    random.seed(4)
    gains = [random.gauss(1, 2) for _ in range(17)]
    got = inference.block_bootstrap_interval(spark.createDataFrame(list(enumerate(gains)), "origin long, gain double"), 17, 0.9, 200, 9, 4).first()
    draw, means = random.Random(9), []
    for _ in range(200):
        sample = []
        for _ in range(math.ceil(17 / 4)):
            s = draw.randrange(17)
            sample += [gains[(s + k) % 17] for k in range(4)]
        means.append(sum(sample[:17]) / 17)
    means.sort()

    def percentile(p):
        x = p * 199
        a = math.floor(x)
        return means[a] + (x - a) * (means[min(a + 1, 199)] - means[a])

    assert math.isclose(got.lower, percentile(0.05), abs_tol=1e-8) and math.isclose(got.upper, percentile(0.95), abs_tol=1e-8)


def test_unit_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(i % 6, float(i), 0.5, 0.7) for i in range(40)], "u int, r double, p double, t double")
    run = lambda: inference.unit_bootstrap(df, "u", F.col("t") / F.col("p"), F.lit(1.0), "r", 50, 3, 0.9).first()
    assert run() == run() and run().valid_replicates == 50


def test_rolling_origin_takes_equal_times_in_the_declared_order(spark):
    df = spark.createDataFrame([("2024-01-01", 3, 4.0), ("2024-01-01", 1, 1.0), ("2024-01-01", 2, 2.0), ("2024-01-02", 4, 8.0)], "at string, id int, v double")
    spec = {"kind": "rolling_origin_naive_mae", "field": "v", "minimum_history": 2, "horizon": 1}
    got = m.measure(df, spec | {"order": ["id"]}, "at").first()
    assert (got.status, got.n, got.value) == ("completed", 2, 3.0)
    # an order that leaves ties open, or none, gives no figure
    assert m.measure(df, spec, "at").first().status == "unverifiable"
    assert m.measure(df.withColumn("id", F.lit(1)), spec | {"order": ["id"]}, "at").first().status == "unverifiable"


def test_quartiles_of_distributions_hold_no_values_in_one_task(spark):
    """A percentile aggregate buffers every different value of a group in one task; these count values first."""
    from quernstone.operators import statistics as st

    df = spark.range(2001).select((F.col("id") * 3).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("k"), (F.col("id") % 2 == 0).alias("f"))
    plans = {"distribution": st.distribution(df, "v"), "category": st.category_summary(df, "k", "v", "v"), "features": st.feature_contrasts(df, ["f"], "v")}
    assert not [k for k, p in plans.items() if "percentile(" in p._jdf.queryExecution().optimizedPlan().toString()]
    one = plans["distribution"].first()
    assert (one.n, one.p25, one.median, one.p75) == (2001, 1500.0, 3000.0, 4500.0)
    assert {(r.category, r.median) for r in plans["category"].collect()} == {("0", 3000.0), ("1", 3000.0)}
    assert plans["features"].first().median_without == 3000.0
    assert st.distribution(df.filter("v < 0"), "v").first().median is None


def test_draws_of_a_sequence_are_those_of_python_however_many(spark):
    draw = random.Random(5)
    want = [draw.randrange(1500) for _ in range(3_000_000)]
    got = inference.sequence_draws(spark, 5, 1500, 3_000_000).orderBy("draw").toPandas()
    assert got["draw"].tolist() == list(range(3_000_000)) and got["value"].tolist() == want
    assert inference.sequence_draws(spark, 5, 1, 3).count() == 3 and inference.sequence_draws(spark, 5, 0, 0).count() == 0


def test_unit_bootstrap_of_more_draws_than_a_driver_should_make(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 2).cast("double").alias("r"))
    got = inference.unit_bootstrap(df, "id", F.lit(2.0), F.lit(1.0), "r", 100, 3, 0.9).first()
    assert got.valid_replicates == 100 and 0.49 < got.lower < 0.5 < got.upper < 0.51


def test_policy_and_conclusion_ladders():
    assert inference.select_policy(1.0, 0.2, 50, 10, True, True, 0.5) == ("candidate", [])
    assert inference.select_policy(1.0, None, 5, 10, True, False, 0.5)[1] == ["interval_includes_zero", "insufficient_overlap", "unstable_under_sensitivity"]
    rows = [{"model": "base", "score": 2.0, "relative_improvement": 0.0, "origins": 9}, {"model": "x", "score": 1.0, "relative_improvement": 0.5, "origins": 9}]
    assert inference.conclusion(rows, "base", 0.1, 5) == ("candidate_wins", "x")
    assert inference.conclusion(rows, "base", 0.1, 5, (-1.0, 1.0)) == ("uncertain_difference", "base")
    assert inference.conclusion(rows, "base", 0.1, 20)[0] == "insufficient_origins"


def test_exact_quantiles(spark):
    random.seed(3)
    groups = {"even": [float(i) for i in range(1000)], "hot": [5.0] * 900 + [float(i) for i in range(300)], "one": [2.5], "two": [1.0, 2.0], "wide": [random.lognormvariate(0, 4) for _ in range(5000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: [r[s] for s in shares] for r in series.exact_quantiles(counts, ["g"], "v", "n", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, list(shares.values())), rtol=1e-12)
    assert table.exact_median(spark.createDataFrame([], "v double"), F.col("v")) is None


def test_sampling(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 5, 2)]) for i in range(18)], "i int, g string")
    assert [r.i for r in sampling.evenly_spaced(df, ["i"], 1).collect()] == [9]
    assert sorted(r.i for r in sampling.evenly_spaced(df, ["i"], 4).collect()) == [0, 6, 11, 17]
    assert sorted(r.i for r in sampling.stratified(df, ["g"], ["i"], 4).collect()) == [0, 5, 10, 11]
    assert sampling.cursor_reset_order([3, 1, 2], 6) == [0, 1, 0, 2, 0, 2]
    assert sampling.balanced(df, ["g"], ["i"], 7).count() == 7
    assert {r.band for r in sampling.contrast(df, "i", ["g"], 5).collect()} == {"high", "middle", "low"}
    every = sampling.contrast(df, "i", ["g"], 99).collect()
    assert len(every) == df.count() and {r.i: r.band for r in every} == {i: "high" if i > 8.5 else "low" for i in range(18)}
    assert [sampling.recommended_count(n) for n in (10, 40, 41, 10_000)] == [10, 40, 26, 60]
    assert sampling.greedy_budget([("a", 5), ("b", 9), ("c", 4)], 5, 10) == ["a", "c"]


def test_fuzzy_match_statuses(spark):
    a = spark.createDataFrame([(1, "d", "spring sale report"), (2, "d", "zzzz"), (3, "d", "abcdefgh one")], "i int, day string, t string")
    b = spark.createDataFrame([(10, "d", "spring sale reports"), (11, "d", "abcdefgh onx"), (12, "d", "abcdefgh ony"), (13, "e", "zzzz")], "k int, day string, s string")
    by = {r.i: r for r in matching.fuzzy_match(a, b, ["day"], "i", "t", "k", "s").collect()}
    assert (by[1].status, by[1].k, by[2].status, by[3].status, by[3].k) == ("matched", 10, "none", "ambiguous", None)


def test_rules_roots_and_intervals(spark):
    import datetime

    df = spark.createDataFrame([(1, "red ring"), (2, "small"), (3, "plain"), (4, "small red")], "k int, t string")
    by = {r.k: (r.rule, r.status) for r in matching.rule_join(df, "k", "t", [("a", 2, "red"), ("b", 2, "ring"), ("c", 1, "small")]).collect()}
    assert by == {1: (None, "ambiguous"), 2: ("c", "matched"), 3: (None, "unmatched"), 4: ("a", "matched")}
    d = datetime.date
    iv = spark.createDataFrame([("a", d(2024, 1, 1), d(2024, 1, 3)), ("b", d(2024, 1, 3), d(2024, 1, 4))], "k string, s date, e date")
    assert [(str(r.day), r.first, r.second) for r in matching.overlapping_intervals(iv, "k", "s", "e").collect()] == [("2024-01-03", "a", "b")]


def test_corpus_functions(spark):
    f = lambda c, v: spark.range(1).select(c(F.lit(v))).first()[0]
    stems = {"x/Plan_v2 (1).docx": "plan", "copy.md": "copy", "v2 final.md": "v2", "预算 最终版.xlsx": "预算", "报告（2） 副本3.csv": "报告", "sales_20240105.csv": "sales20240105", "Deck-Final v1.2.pptx": "deck", "!!.md": ""}
    assert {p: f(corpus.family_stem, p) for p in stems} == stems
    containers = {"a.PNG": "image", "a.md": "text_document", "a.xlsx": "workbook", "a.tsv": "table", "a.pdf": "document", "a.mkv": "recording", "a.zip": "file", "a": "file"}
    assert {p: f(corpus.container_type, p) for p in containers} == containers
    dates = {
        "2024-03-05/export_20240401.csv": "2024-04-01", "2024-3-5/x.csv": "2024-03-05", "2024年3月5日/x.csv": "2024-03-05", "3月15日/x.csv": "--03-15", "0315/x.csv": "--03-15", "a/b/c/1301.csv": None,
        "2024.13.05/20240102.csv": "2024-01-02", "2024-01-01/a/b/c/x.csv": None, "x 120240102.csv": None,
    }
    assert {p: f(corpus.collection_date, p) for p in dates} == dates
    assert f(corpus.top_folder, "a.txt") == "(root)"


def test_chunks_cover_and_overlap():
    text = "\n".join("word " * 60 for _ in range(30))
    spans = list(ot.chunk_spans(text, 1200, 120))
    assert all(b - a <= 1200 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert all(spans[i + 1][0] < spans[i][1] for i in range(len(spans) - 1))
    assert list(ot.chunk_spans("")) == []


def test_coverage_first(spark):
    assert sampling.cover_in_turn([[("d1", ["a", "b", "c"]), ("d2", ["e"])], [("f1", ["a", "b"]), ("f2", ["c", "e"])]], 4) == ["a", "e", "b", "c"]
    df = spark.createDataFrame([("a", "d1", "f1", 1), ("b", "d1", "f1", 2), ("c", "d1", "f2", 3), ("e", "d2", "f2", 4)], "id string, d string, f string, t int")
    assert {r.id for r in sampling.family_stratified(df, "id", ["d", "f"], ["id"], 3).collect()} == {"a", "e", "b"}
    for name in sampling.STRATEGIES:
        rows, _ = sampling.select(df, name, 2, "id", "f", "t", "t")
        assert rows.count() == (4 if name == "full_census" else 2)
    with pytest.raises(ValueError):
        sampling.select(df, "luck", 2, "id", "f", "t")


def test_projects(spark):
    paths = spark.createDataFrame([("r/pyproject.toml",), ("r/sub/pyproject.toml",), ("r/README.md",), ("x/y/README.md",), ("r/tests/test_a.py",), ("r/src/a.py",)], "path string")
    roots = corpus.project_roots(paths, "path", ["pyproject.toml"], ["README.md"])
    assert {(r.root, r.marker) for r in roots.collect()} == {("r", "strong"), ("x/y", "weak")}
    p = corpus.project_profile(paths.withColumn("project", F.lit("r")), "project").first()
    assert (p.files, p.test, p.code, p.test_backed) == (6, 1, 1, True)


def test_integrity(spark):
    a = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, ref int")
    b = spark.createDataFrame([(5, 1.0), (6, 2.0)], "id int, v double")
    assert [(r.child, r.value, r.rows) for r in matching.referential_integrity({"a": a, "b": b}, [("a", "ref", "b", "id")]).collect()] == [("a", "9", 1)]
    c = spark.createDataFrame([(5, 1.005), (7, 2.0)], "id int, v double")
    assert {(r.id, r.problem) for r in matching.reconcile(b, c, ["id"], "v").collect()} == {(6, "one_side"), (7, "one_side")}
    assert matching.duplicate_keys(a.unionByName(a), ["id"]).count() == 3


def test_numbers_of_any_order(spark):
    """Texts with one prefix, fractions, nulls, falling orders: numbers follow the order, whatever the cuts."""
    rows = [(f"Customer#{i % 37:09d}" if i % 11 else None, (i * 7919 % 1000) / 1000, i) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, score double, id int").repartition(6)
    got = {r.id: r.n for r in series.numbered(df, ["name", F.desc("score"), "id"], "n").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert [got[r[2]] for r in want] == list(range(500))
    plan = series.numbered(df, ["score", "id"])
    assert plan.columns == ["name", "score", "id", "ordinal"] and series.numbered(df.limit(0), ["id"]).count() == 0


def test_expanding_median_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "MEDIAN_BLOCK", 8)
    draw = random.Random(5)
    values = [float(draw.choice([0, 0, 1, 2, 2, 5, 90 if i > 60 else 3])) for i in range(101)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(4)
    got = {r.i: r.m for r in series.expanding_median(df, "i", "v", "m").collect()}
    assert got == {i: statistics.median(values[:i]) if i else None for i in range(101)}
    assert series.expanding_median(df.limit(0), "i", "v", "m").count() == 0


def test_draws_of_a_sequence_are_not_broadcast(spark):
    """Their number grows with the units, which the few rows that they are made from don't show."""
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("double").alias("r"))
    gains = df.select(F.col("id").alias("origin"), F.col("r").alias("gain"))
    for found in (inference.unit_bootstrap(df, "id", F.lit(2.0), F.lit(1.0), "r", 20, 3, 0.9), inference.block_bootstrap_interval(gains, 1000, 0.9, 20, 3, 4)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        joins = re.findall(r"\w*Join\w* \[(?:value|start)#\w+\]", plan)
        assert joins and all(j.startswith("SortMergeJoin") for j in joins), plan
