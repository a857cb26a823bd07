"""Registered queries of policy evaluation, declared actions and bootstraps whose draws SQL can repeat."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, policy
from ..session import table
from .catalog import _FORECAST_SQL, MODELS, daily_series, query, rounded

_ACTIONS = ("view", "click", "purchase", "signup", "error")
_REPLICATES, _SEED = 200, 5

BINDING: dict[str, Any] = {
    "action_values": list(_ACTIONS), "logged_action_field": "event_type", "propensity_field": "propensity", "reward_field": "value", "bootstrap_unit_field": "user_id",
    "policy_specs": [
        {"policy_id": "as_logged", "policy_type": "logging_policy", "q_policy_field": "q"}, {"policy_id": "even", "policy_type": "uniform_policy", "q_policy_field": "q"},
        {"policy_id": "tilted", "policy_type": "action_probabilities", "action_probability_fields": {a: f"p_{a}" for a in _ACTIONS}, "q_policy_field": "q_tilted"},
    ],
    "action_options": ["as_logged", "even", "tilted"], "baseline_action": "as_logged", "fallback_action": "even", "estimators": ["ips", "snips", "doubly_robust"], "primary_estimator": "snips",
    "q_logged_field": "q", "minimum_effective_sample_size": 5.0, "maximum_importance_weight": 4.0, "minimum_advantage": 0.1, "confidence_level": 0.9, "bootstrap_replicates": _REPLICATES, "bootstrap_seed": _SEED,
    "weight_clip_grid": [1.5, 3.0], "propensity_floor_grid": [0.05, 0.2],
}


def logged_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log: propensities by user, a policy that prefers purchases, and guesses of the reward."""
    e = table(spark, sf, "events")
    tilted = (F.when(F.lit(a == "purchase"), 0.6).otherwise(0.1).alias(f"p_{a}") for a in _ACTIONS)
    return e.select("event_type", "user_id", "value", (F.lit(0.15) + 0.05 * (F.col("user_id") % 3)).alias("propensity"), *tilted, (F.col("user_id") % 10).cast("double").alias("q"), (F.col("user_id") % 10 + 1).cast("double").alias("q_tilted"))


_LOG = """l AS (SELECT CAST(user_id AS VARCHAR) AS unit, value AS r, 0.15::DOUBLE + 0.05::DOUBLE * (user_id % 3) AS p, (user_id % 10)::DOUBLE AS q, event_type FROM events),
    t AS (SELECT unit, r, p, q, unnest([{'policy_id': 'as_logged', 't': p, 'qp': q}, {'policy_id': 'even', 't': 0.2::DOUBLE, 'qp': q}, {'policy_id': 'tilted', 't': CASE event_type WHEN 'purchase' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END, 'qp': q + 1}], recursive := true) FROM l),
    u AS (SELECT policy_id, unit, count(*) AS n, sum(t / p) AS w, sum(t / p * r) AS wr, sum(qp + t / p * (r - q)) AS dr, max(t / p) AS top, count(*) FILTER (t / p > 0) AS positive FROM t GROUP BY 1, 2)"""


@query(f"""WITH {_LOG} SELECT policy_id, round(sum(wr) / sum(n), 6) AS ips, round(sum(wr) / sum(w), 6) AS snips, round(sum(dr) / sum(n), 6) AS doubly_robust, round(sum(w) ** 2 / sum(w * w), 6) AS effective_sample_size,
    round(max(top), 6) AS maximum_observed_importance_weight, CAST(sum(positive) AS BIGINT) AS positive_weight_row_count, count(*) AS independent_unit_count, count(*) FILTER (positive > 0) AS positive_weight_unit_count,
    CASE WHEN sum(w) ** 2 / sum(w * w) >= 5 AND max(top) <= 4 THEN 'supported' ELSE 'failed' END AS overlap_status FROM u GROUP BY 1""")
def policy_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(policy.policy_table(policy.unit_sums(policy.logged_rows(logged_events(spark, sf), BINDING), BINDING), BINDING))


def _limits() -> list[int]:
    """The Poisson(1) distribution function in units of 2^-32, for SQL."""
    total, term, limits = 0.0, math.exp(-1), []
    for k in range(12):
        total += term
        limits.append(int(total * 2**32))
        term /= k + 1
    return limits


@query(f"""WITH {_LOG}, s AS (SELECT unit, any_value(n) AS n, max(w) FILTER (policy_id = 'as_logged') AS w0, max(wr) FILTER (policy_id = 'as_logged') AS wr0, max(w) FILTER (policy_id = 'even') AS w1, max(wr) FILTER (policy_id = 'even') AS wr1,
        max(w) FILTER (policy_id = 'tilted') AS w2, max(wr) FILTER (policy_id = 'tilted') AS wr2 FROM u GROUP BY 1),
    d AS (SELECT *, CAST(concat('0x', substr(md5(concat('{_SEED}:', rep, ':', unit)), 1, 8)) AS BIGINT) AS bits FROM s, range({_REPLICATES}) g(rep)),
    k AS (SELECT *, len(list_filter({_limits()}, lambda z: bits >= z)) AS k FROM d),
    b AS (SELECT rep, sum(k * wr1) / sum(k * w1) - sum(k * wr0) / sum(k * w0) AS even, sum(k * wr2) / sum(k * w2) - sum(k * wr0) / sum(k * w0) AS tilted FROM k WHERE k > 0 GROUP BY 1),
    o AS (SELECT sum(wr1) / sum(w1) - sum(wr0) / sum(w0) AS even, sum(wr2) / sum(w2) - sum(wr0) / sum(w0) AS tilted FROM s)
    SELECT 'even' AS candidate_policy_id, round((SELECT even FROM o), 6) AS advantage_over_baseline, round(quantile_cont(even, 0.025), 6) AS lower, round(quantile_cont(even, 0.975), 6) AS upper, count(even) AS valid_bootstrap_replicates FROM b
    UNION ALL SELECT 'tilted', round((SELECT tilted FROM o), 6), round(quantile_cont(tilted, 0.025), 6), round(quantile_cont(tilted, 0.975), 6), count(tilted) FROM b""")
def policy_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(policy.policy_comparisons(policy.unit_sums(policy.logged_rows(logged_events(spark, sf), BINDING), BINDING), BINDING))


@query(f"""WITH {_LOG}, c AS (SELECT *, least(t / greatest(p, f), c) AS x FROM t, unnest([1.5::DOUBLE, 3.0::DOUBLE]) a(c), unnest([0.05::DOUBLE, 0.2::DOUBLE]) b(f)),
    v AS (SELECT c AS weight_clip, f AS propensity_floor, policy_id, avg(x * r) AS ips, sum(x * r) / sum(x) AS snips, avg(qp + x * (r - q)) AS doubly_robust FROM c GROUP BY 1, 2, 3)
    SELECT weight_clip, propensity_floor, policy_id, estimator, round(value, 6) AS value FROM (UNPIVOT v ON ips, snips, doubly_robust INTO NAME estimator VALUE value)""")
def policy_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(policy.policy_grid(policy.logged_rows(logged_events(spark, sf), BINDING), BINDING))


@query("""WITH r AS (SELECT p_type AS action, 0.5::DOUBLE AS p, (1 + p_size % 3)::DOUBLE AS w, p_retailprice AS b, 10.0::DOUBLE * p_size AS c, p_size AS v FROM part WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD')),
    a AS (SELECT action, count(*) AS scenario_count, sum(w * (p * b - c)) / sum(w) AS e, min(p * b - c) AS lo, max(p * b - c) AS hi, avg(v) AS v0, max(v) AS v1 FROM r GROUP BY 1)
    SELECT action, scenario_count, round(e, 6) AS expected_net_utility, round(lo, 6) AS minimum, round(hi, 6) AS maximum, round(v0, 6) AS mean_size, v1::DOUBLE AS largest_size, v0 BETWEEN 20 AND 30 AND v1 <= 50 AS feasible FROM a""")
def decision_actions(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_type", "p_retailprice", "p_size", F.lit(0.5).alias("p"), (10.0 * F.col("p_size")).alias("cost"), (1 + F.col("p_size") % 3).alias("w"))
    rules = [{"field": "p_size", "aggregation": "mean", "operator": "between", "value": [20, 30]}, {"field": "p_size", "aggregation": "max", "operator": "lte", "value": 50}]
    b = {"action_options": ["PROMO", "ECONOMY", "STANDARD"], "action_field": "p_type", "probability_field": "p", "weight_field": "w", "benefit_field": "p_retailprice", "cost_field": "cost", "constraint_rules": rules}
    found = policy.action_table(part, b)
    return rounded(found.select("action", "scenario_count", "expected_net_utility", "minimum", "maximum", F.col("constraints")[0]["observed"].alias("mean_size"), F.col("constraints")[1]["observed"].alias("largest_size"), "feasible"))


@query(f"""{_FORECAST_SQL}, g AS (SELECT row_number() OVER (ORDER BY origin) - 1 AS j, abs(m_last - observed) - abs(m_mean - observed) AS gain, count(*) OVER () AS n FROM k),
    b AS (SELECT rep, blk, CAST(concat('0x', substr(md5(concat('11:', rep, ':', blk)), 1, 8)) AS BIGINT) % (SELECT max(n) FROM g) AS first FROM range(500) a(rep), range(CAST(ceil((SELECT max(n) FROM g) / 3) AS BIGINT)) c(blk)),
    x AS (SELECT rep, (first + o) % (SELECT max(n) FROM g) AS j FROM b, range(3) d(o) WHERE blk * 3 + o < (SELECT max(n) FROM g)),
    m AS (SELECT rep, avg(gain) AS mean FROM x JOIN g USING (j) GROUP BY 1)
    SELECT round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, count(*) AS replicates FROM m""")
def forecast_bootstrap_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of forecast_bootstrap_ci with draws that tasks make and SQL can repeat."""
    found = inference.forecasts(daily_series(spark, sf), MODELS, 2, 8)
    gains = found.select("origin", (F.abs(F.col("m_last") - F.col("observed")) - F.abs(F.col("m_mean") - F.col("observed"))).alias("gain"))
    return rounded(inference.block_bootstrap_interval(gains, found.count(), 0.95, 500, 11, 3, digests=True))
