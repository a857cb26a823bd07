"""Re-verification of a ledger of findings: all its figures again from one scan, and what its rows and evidence lack.

``fresh_figures`` turns many measurements over many windows into one aggregation. The
windows' bounds cut time into segments; a row finds its segment in a tree of
comparisons, meets the windows that cover the segment, and is aggregated by window.
A field is read as a number once, equal measurements are one figure. Kinds that need
rows in order, or subgroups, take a pass of their own (``OWN_PASS``).
``reverify`` holds the figures against the stated ones, ``ledger_problems`` names what
the rows break, both as tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SpecError, predicate
from ..functions.types import exact_sum, is_invalid_number, is_missing, strict_number_of, temporal
from .measure import DIGITS, KINDS, measure

#: Different measurements of one aggregation; windows and findings may be any number.
FIGURES = 64
#: Kinds whose rows meet in order or by subgroup.
OWN_PASS = frozenset({"max_drawdown_pct", "subgroup_difference_spread", "lagged_pearson", "walk_forward_interval_mae", "rolling_origin_naive_mae"})
SIMPLE = ("first", "last", "min", "max", "mean", "median", "sum", "period_change", "period_pct_change")
TIMES = ("date_of_min", "date_of_max", "time_of_min", "time_of_max")
GROUPS = ("group_mean_difference", "group_median_difference", "group_rate_difference")

#: value, text, n and whether the cells allow a figure: aggregates
Figure = tuple[Column, Column, Column, Column]


class _Scan:
    """Columns that the figures of one scan share."""

    def __init__(self, df: DataFrame, time: str):
        self.df, self.time = df, time
        self.columns: dict[str, Column] = {}

    def _shared(self, key: str, make: Callable[[], Column]) -> Column:
        if key not in self.columns:
            self.columns[key] = make()
        return F.col(f"_{list(self.columns).index(key)}")

    def at(self) -> Column:
        given = dict(self.df.dtypes)[self.time]
        return self._shared("at", lambda: temporal(F.col(self.time)) if given == "string" else F.col(self.time).cast("timestamp_ntz"))

    def number(self, field: str) -> Column:
        return self._shared(f"number {field}", lambda: strict_number_of(self.df, field))

    def invalid(self, field: str) -> Column:
        return self._shared(f"invalid {field}", lambda: is_invalid_number(F.col(field)))

    def present(self, field: str) -> Column:
        return self._shared(f"present {field}", lambda: ~is_missing(F.col(field)))

    def holds(self, field: str, condition: dict[str, Any]) -> Column:
        return self._shared(f"holds {field} {json.dumps(condition, sort_keys=True)}", lambda: predicate(F.col(field), condition, strict_number_of(self.df, field)))

    def prepared(self) -> DataFrame:
        return self.df.select("*", *(c.alias(f"_{k}") for k, c in enumerate(self.columns.values())))


def _figure(scan: _Scan, m: dict[str, Any], inside: Column) -> Figure:
    kind, none = m["kind"], F.lit(None)
    if kind == "count":
        n = F.count_if(inside)
        return n.cast("double"), none, n, F.lit(True)
    if kind in ("proportion", "group_rate_difference"):
        p = scan.holds(m["field"], m["condition"])
        in_group = [F.col(m["group_field"]) == F.lit(m[g]) for g in ("group_a", "group_b")] if kind != "proportion" else [F.lit(True)]
        counted = inside & reduce(Column.__or__, in_group)
        shares = [F.avg(F.when(inside & g, p.cast("double"))) for g in in_group]
        n = F.count(F.when(counted, p))
        return reduce(Column.__sub__, shares), none, F.count_if(counted) if kind == "proportion" else n, n == F.count_if(counted)
    field = m["field"]
    value, bad = scan.number(field), scan.invalid(field)
    cell = inside & scan.present(field)
    if kind in GROUPS:
        in_group = [F.col(m["group_field"]) == F.lit(m[g]) for g in ("group_a", "group_b")]
        cell &= in_group[0] | in_group[1]
        middle = F.avg if kind == "group_mean_difference" else lambda c: F.percentile(c, 0.5)
        a, b = (middle(F.when(cell & g, value)) for g in in_group)
        return a - b, none, F.count(F.when(cell, value)), F.count_if(cell & bad) == 0
    if kind == "difference_in_differences":
        if m["treated_value"] == m["control_value"] or m["pre_value"] == m["post_value"]:
            raise SpecError("two groups and two periods are needed")
        pre, post = (F.col(m["period_field"]) == F.lit(m[p]) for p in ("pre_value", "post_value"))
        mean = lambda g, p: F.avg(F.when(inside & p & (F.col(m["group_field"]) == F.lit(m[g])), value))
        effect = (mean("treated_value", post) - mean("treated_value", pre)) - (mean("control_value", post) - mean("control_value", pre))
        ordered = F.max(F.when(inside & pre, scan.at())) < F.min(F.when(inside & post, scan.at()))
        return effect, none, F.count(F.when(inside, value)), ordered & (F.count_if(inside & bad) == 0)
    n, sound = F.count(F.when(cell, value)), F.count_if(cell & bad) == 0
    if kind in TIMES:
        sign = 1 if kind.endswith("min") else -1
        at = F.min_by(scan.at(), F.when(cell, F.struct((value * sign).alias("v"), scan.at().alias("at"))))
        return none, F.date_format(at, "yyyy-MM-dd" if kind.startswith("date") else "yyyy-MM-dd HH:mm:ss.SSSSSS"), n, sound
    if kind not in SIMPLE:
        raise SpecError(f"no such measurement: {kind!r}")
    order = F.when(cell, F.struct(scan.at().alias("at"), *m.get("order", [])))
    own = F.when(cell, value)
    if kind in ("first", "last", "period_change", "period_pct_change"):
        first, last = F.min_by(value, order), F.max_by(value, order)
        found = {"first": first, "last": last, "period_change": last - first, "period_pct_change": (F.try_divide(last, first) - 1) * 100}[kind]
    else:
        found = {"min": F.min, "max": F.max, "mean": F.avg, "sum": exact_sum, "median": lambda c: F.percentile(c, 0.5)}[kind](own)
    return found, none, n, sound


def _bounds(df: DataFrame, windows: list[tuple[str | None, str | None]]) -> list[tuple[datetime | None, datetime | None, bool]]:
    """Each window's first and first later moment, and whether both were understood; no table is read."""
    cells = [c for s, e in windows for c in (temporal(F.lit(s)), temporal(F.lit(e), end_of_day=True))]
    told = df.sparkSession.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cells))).first() if cells else ()
    out = []
    for k, (start, end) in enumerate(windows):
        first, last = told[2 * k], told[2 * k + 1]
        out.append((first, last and last + timedelta(microseconds=1), not (start and first is None or end and last is None)))
    return out


def _segment(at: Column, cuts: list[datetime], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted cuts aren't after at, by halving."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(at < F.lit(str(cuts[middle])).cast("timestamp_ntz"), _segment(at, cuts, low, middle)).otherwise(_segment(at, cuts, middle + 1, high))


def _by_window(df: DataFrame, findings: list[dict[str, Any]], time: str) -> DataFrame:
    """finding_id, kind, value, text, n and status of findings of at most FIGURES different measurements: one scan, one aggregation."""
    spark = df.sparkSession
    windows = list(dict.fromkeys((f.get("start"), f.get("end")) for f in findings))
    wanted = {json.dumps(f["measurement"], sort_keys=True): f["measurement"] for f in findings}
    number = {k: i for i, k in enumerate(wanted)}
    place = lambda f: (windows.index((f.get("start"), f.get("end"))), number[json.dumps(f["measurement"], sort_keys=True)])
    asked = [(f["finding_id"], f["measurement"]["kind"], *place(f)) for f in findings]

    bounds = _bounds(df, windows)
    cuts = sorted({c for first, later, _ in bounds for c in (first, later) if c})
    at = {c: k + 1 for k, c in enumerate(cuts)}
    covers = [(s, w) for w, (first, later, known) in enumerate(bounds) if known for s in range(at[first] if first else 0, at[later] if later else len(cuts) + 1)]
    scan = _Scan(df, time)
    segment = _segment(scan.at(), cuts)
    figures = []
    for k, m in enumerate(wanted.values()):
        own = {w for _, _, w, i in asked if i == k}
        use = F.lit(True) if len(own) == len(windows) else F.col("_w").isin(sorted(own))
        value, text, n, sound = _figure(scan, m, use)
        figures.append(F.struct(F.lit(k).alias("m"), value.cast("double").alias("value"), text.cast("string").alias("text"), n.cast("long").alias("n"), F.coalesce(sound, F.lit(False)).alias("sound")).alias(f"f{k}"))
    # what is broadcast has the ledger's size, not the table's
    table = F.broadcast(spark.createDataFrame(covers, "_segment int, _w int"))
    met = scan.prepared().filter(scan.at().isNotNull()).withColumn("_segment", segment).join(table, "_segment")
    by = met.groupBy("_w").agg(*figures).select(F.col("_w").alias("w"), F.inline(F.array(*(F.col(f"f{k}") for k in range(len(figures))))))
    ledger = spark.createDataFrame(asked, "finding_id string, kind string, w int, m int")
    found = ledger.join(by, ["w", "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty_count = (F.col("kind") == "count") & (F.col("n") == 0)
    value = F.when(empty_count, F.lit(0.0)).otherwise(F.col("value"))
    known = empty_count | (F.coalesce("sound", F.lit(False)) & (F.col("value").isNotNull() | F.col("text").isNotNull()))
    return found.select("finding_id", "kind", F.when(known, F.round(value, DIGITS)).alias("value"), F.when(known, F.col("text")).alias("text"), "n", F.when(known, "completed").otherwise("unverifiable").alias("status"))


def fresh_figures(df: DataFrame, findings: list[dict[str, Any]], time: str) -> DataFrame:
    """finding_id, kind, value, text, n, status of every finding: {finding_id, measurement, start, end}.

    Results are those of ``measure``. A ledger is a document: its length is not the table's.
    """
    for f in findings:
        if (f.get("measurement") or {}).get("kind") not in KINDS:
            raise SpecError(f"no such measurement: {f.get('finding_id')}")
    parts, batch, seen = [], [], set()
    for f in sorted((f for f in findings if f["measurement"]["kind"] not in OWN_PASS), key=lambda f: json.dumps(f["measurement"], sort_keys=True)):
        key = json.dumps(f["measurement"], sort_keys=True)
        if key not in seen and len(seen) == FIGURES:
            parts.append(_by_window(df, batch, time))
            batch, seen = [], set()
        batch.append(f)
        seen.add(key)
    if batch:
        parts.append(_by_window(df, batch, time))
    alone = [f for f in findings if f["measurement"]["kind"] in OWN_PASS]
    columns = ["finding_id", "kind", "value", "text", "n", "status"]
    parts += [measure(df, f["measurement"], time, f.get("start"), f.get("end")).withColumn("finding_id", F.lit(f["finding_id"])).select(*columns) for f in alone]
    if not parts:
        return df.sparkSession.createDataFrame([], "finding_id string, kind string, value double, text string, n long, status string")
    return reduce(DataFrame.unionByName, parts)


def reverify(sources: dict[str, tuple[DataFrame, str]], findings: list[dict[str, Any]], stated: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The ledger's stated figures (finding_id, value, text) against fresh ones, source by source: confirmed, differs, unverifiable or unstated.

    sources: rows and time column by name; findings name their source.
    """
    unknown = sorted({str(f.get("source")) for f in findings} - set(sources))
    if unknown:
        raise SpecError("unknown sources: " + ", ".join(unknown))
    fresh = reduce(DataFrame.unionByName, [fresh_figures(df, [f for f in findings if f["source"] == name], time).withColumn("source", F.lit(name)) for name, (df, time) in sources.items()])
    told = stated.select("finding_id", F.round("value", DIGITS).alias("stated_value"), F.col("text").alias("stated_text"))
    same = F.when(F.col("value").isNotNull(), F.abs(F.col("value") - F.col("stated_value")) <= tolerance).otherwise(F.col("text") == F.col("stated_text"))
    verdict = (
        F.when(F.col("stated_value").isNull() & F.col("stated_text").isNull(), "unstated").when(F.col("status") != "completed", "unverifiable")
        .when(F.coalesce(same, F.lit(False)), "confirmed").otherwise("differs")
    )
    return fresh.join(told, "finding_id", "left").select("finding_id", "source", "kind", "value", "text", "n", "status", "stated_value", "stated_text", verdict.alias("verdict"))


#: What each advanced level of claim needs: its layer, and the kinds of validation that count.
ADVANCED = {
    "prediction": ("predictive", ("out_of_sample",)),
    "causal_effect": ("causal", ("randomized_experiment", "identified_observational_estimate")),
    "decision_rule": ("decision", ("decision_analysis", "policy_evaluation")),
}
#: The lane and the states of evidence that carries a result.
RESULT_LANE, RESULT_DIRECTNESS, RESULT_STATES = "analysis_result", "derived", ("completed", "succeeded")


def ledger_problems(findings: DataFrame, links: DataFrame, evidence: DataFrame, permitted: list[str]) -> DataFrame:
    """(finding_id, problem, ref): what a ledger's rows break, one row each.

    findings: finding_id, claim_level, title, claim, layer, validation_type, validation_status; links: finding_id, ref
    (evidence of its result); evidence: ref, verified, lane, directness, status, layer, claim; permitted: layers whose
    claims the question allows. Evidence and links are joined by key, whatever their size.
    """
    level = F.col("claim_level")
    layer = F.coalesce(*(F.when(level == k, F.lit(v[0])) for k, v in ADVANCED.items()))
    kinds = F.coalesce(*(F.when(level == k, F.array(*map(F.lit, v[1]))) for k, v in ADVANCED.items()))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    named = lambda problem, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(problem))
    times = findings.groupBy("finding_id").agg(F.count(F.lit(1)).alias("times"))
    rows = findings.join(times, "finding_id", "left")
    advanced = layer.isNotNull()
    differs = lambda a, b: ~a.eqNullSafe(b)
    own = F.array_compact(F.array(
        named("finding_id is required", blank(F.col("finding_id"))), named("finding_id is duplicated", F.col("times") > 1), named("claim is required", blank(F.col("claim"))),
        named("the title must be the measured claim", advanced & differs(F.col("title"), F.col("claim"))), named("the claim's layer is not permitted", advanced & ~F.coalesce(layer.isin(permitted), F.lit(False))),
        named("the design is of another layer", advanced & differs(F.col("layer"), layer)),
        named("the validation does not carry the claim", advanced & ~F.coalesce(F.array_contains(kinds, F.col("validation_type")), F.lit(False))),
        named("the validation is not supported", advanced & differs(F.col("validation_status"), F.lit("supported"))),
    ))
    by_row = rows.select("finding_id", F.explode(own).alias("problem"), F.lit(None).cast("string").alias("ref"))
    bare = rows.filter(advanced).join(links, "finding_id", "left_anti").select("finding_id", F.lit("evidence of the result is required").alias("problem"), F.lit(None).cast("string").alias("ref"))
    cards = evidence.select("ref", F.col("verified").alias("e_verified"), F.col("lane").alias("e_lane"), "directness", F.col("status").alias("e_status"), F.col("layer").alias("e_layer"), F.col("claim").alias("e_claim"), F.lit(True).alias("known"))
    met = rows.withColumn("needs", layer).join(links.distinct(), "finding_id").join(cards, "ref", "left")
    there, result = F.coalesce(F.col("known"), F.lit(False)), F.col("needs").isNotNull()
    by_link = F.when(~there, F.array(F.lit("unknown evidence"))).otherwise(F.array_compact(F.array(
        named("unverified evidence", ~F.coalesce("e_verified", F.lit(False))), named("the evidence is no analysis result", result & (differs(F.col("e_lane"), F.lit(RESULT_LANE)) | differs(F.col("directness"), F.lit(RESULT_DIRECTNESS)))),
        named("the result is not complete", result & ~F.coalesce(F.col("e_status").isin(*RESULT_STATES), F.lit(False))),
        named("the result is of another layer", result & differs(F.col("e_layer"), F.col("needs"))), named("the claim is not the measured one", result & differs(F.col("e_claim"), F.col("claim"))),
    )))
    return by_row.unionByName(bare).unionByName(met.select("finding_id", F.explode(by_link).alias("problem"), "ref"))
