"""Registered queries of the table, operational, measurement and inference operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, operational, series, statistics
from ..operators import measure as m
from ..operators import table as t
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# table methods

PROFILE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("UNION ALL".join(f"""
    SELECT '{c}' AS "column", count(*) AS row_count, count(*) FILTER (v IS NULL) AS missing_count, count(*) FILTER (n = 0) AS zero_count,
        count(DISTINCT v) AS unique_non_missing_count, count(n) AS valid_count, round(min(n), 6) AS minimum, round(quantile_cont(n, 0.25), 6) AS q1,
        round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.75), 6) AS q3, round(max(n), 6) AS maximum,
        CASE WHEN count(n) = count(v) AND count(n) > 0 THEN 'numeric' ELSE 'mixed_or_text' END AS inferred_type
    FROM (SELECT v, TRY_CAST(v AS DOUBLE) AS n FROM (SELECT CAST({f"nullif({c}, 0.05)" if c == "l_discount" else c} AS VARCHAR) AS v FROM lineitem))
""" for c in PROFILE_COLUMNS))  # fmt: skip
def table_profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Column profile; a discount of 0.05 counts as missing, to tell missing from zero."""
    rows = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.05)))
    return rounded(t.profile(rows, PROFILE_COLUMNS))


@query("""
    SELECT l_returnflag, l_linestatus, metric, count(*) AS row_count, count(v) AS valid_count, count(*) - count(v) AS missing_or_invalid_count,
        round(sum(v), 2) AS sum, round(avg(v), 6) AS mean, min(v) AS minimum, max(v) AS maximum
    FROM (SELECT CASE WHEN l_returnflag = 'R' THEN '__MISSING__' ELSE l_returnflag END AS l_returnflag, l_linestatus, unnest([{'metric': 'l_quantity', 'v': l_quantity}, {'metric': 'l_discount', 'v': nullif(l_discount, 0)}], recursive := true) FROM lineitem)
    GROUP BY ALL
""")
def grouped_descriptive_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    out = t.grouped(rows, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return out.withColumn("sum", F.round("sum", 2)).withColumn("mean", F.round("mean", 6))


@query("""
    SELECT 'l_quantity' AS "column", count(l_quantity) AS count, count(*) - count(l_quantity) AS missing, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS minimum, max(l_quantity) AS maximum FROM lineitem
    UNION ALL SELECT 'l_tax', count(nullif(l_tax, 0)), count(*) - count(nullif(l_tax, 0)), round(avg(nullif(l_tax, 0)), 6), min(nullif(l_tax, 0)), max(nullif(l_tax, 0)) FROM lineitem
""")
def numeric_summary_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.numeric_summary(table(spark, sf, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0))), ["l_quantity", "l_tax"]))


@query("""
    WITH md AS (SELECT median(o_totalprice) AS md, count(*) AS n FROM orders), ma AS (SELECT median(abs(o_totalprice - md)) AS ma FROM orders, md)
    SELECT o_orderkey, o_totalprice AS value, round(0.6745 * (o_totalprice - md) / ma, 6) AS robust_z, round(md, 6) AS median, round(ma, 6) AS mad, n AS eligible_count
    FROM orders, md, ma WHERE abs(0.6745 * (o_totalprice - md) / ma) >= 1.2
""")
def robust_anomaly_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(t.robust_anomalies(table(spark, sf, "orders"), "o_totalprice", 1.2, ["o_orderkey"]))


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1),
    p AS (SELECT day, lead(day) OVER o AS nxt, row_number() OVER o AS k, sum(v) OVER o AS s, sum(v) OVER () AS total, count(*) OVER () AS n, stddev_pop(v) OVER () AS sd FROM d WINDOW o AS (ORDER BY day)),
    c AS (SELECT day AS split_after, nxt AS split_before, k AS before_count, n - k AS after_count, round(s / k, 6) AS before_mean, round((total - s) / (n - k), 6) AS after_mean,
        round(abs((total - s) / (n - k) - s / k) / sd, 9) AS shift FROM p WHERE k BETWEEN 5 AND n - 5)
    SELECT split_after, split_before, before_count, after_count, before_mean, after_mean, round(shift, 6) AS standardized_mean_shift FROM c ORDER BY shift DESC, before_count LIMIT 1
""")
def change_point_daily_events(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return rounded(t.change_point(daily, "day", "v", 5, []))


# operational comparison

FIRST, SECOND = operational.Period("1996", "1996-01-01", "1996-12-31"), operational.Period("1997", "1997-01-01", "1997-12-31")
PERIODS = [FIRST, SECOND]

_DAILY_SQL = """
    u AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    f AS (SELECT CAST(o_orderdate AS DATE) AS business_date, o_orderpriority AS platform, 1.0 AS orders, o_totalprice AS paid_amount,
            CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS refund_amount, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.1 END AS promo_spend, q AS units,
            CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS after_sale_orders FROM orders LEFT JOIN u ON l_orderkey = o_orderkey),
"""


def _block_sql(fields: str) -> str:
    return f"SELECT {fields}, " + ", ".join(f"round(sum({c}), 4) AS {c}" for c in operational.SUM_FIELDS)


def _ratios_sql() -> str:
    return ", ".join(f"round({a} / nullif({b}, 0), 4) AS {n}" for n, (a, b) in operational.RATIOS.items())


_DAILY_CTE = "WITH " + _DAILY_SQL + f"b AS ({_block_sql('business_date, platform, count(*) AS source_rows')} FROM f GROUP BY ALL), daily AS (SELECT *, {_ratios_sql()} FROM b)"
_PERIOD_SQL = "CASE WHEN business_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN '1996' WHEN business_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN '1997' END"
_SUMMARY_CTE = _DAILY_CTE + f""",
    pd AS (SELECT {_PERIOD_SQL} AS period, * FROM daily),
    sb AS ({_block_sql("period, CASE WHEN grouping(platform) = 1 THEN '(all)' ELSE platform END AS platform, count(DISTINCT business_date) AS days_observed")}
        FROM pd WHERE period IS NOT NULL GROUP BY GROUPING SETS ((period, platform), (period))),
    summary AS (SELECT *, {_ratios_sql()} FROM sb)"""


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by order: platform is the priority; a refund is a finished order, promotion spend a tenth of urgent ones."""
    units = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("units"))
    o = table(spark, sf, "orders").join(units, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.to_date("o_orderdate").alias("business_date"), F.col("o_orderpriority").alias("platform"), F.lit(1.0).alias("orders"), F.col("o_totalprice").alias("paid_amount"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("refund_amount"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") * 0.1).alias("promo_spend"),
        "units", F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0).alias("after_sale_orders"), "o_custkey",
    )


def daily_facts(spark: SparkSession, sf: str) -> DataFrame:
    return operational.aggregate_daily(order_facts(spark, sf))


def _tidy(df: DataFrame) -> DataFrame:
    """Money at 2 digits: sums of many doubles differ in later ones."""
    return df.select(*(F.round(c, 2).alias(c) if c in operational.SUM_FIELDS else F.col(c) for c in df.columns))


def _tidy_sql(keys: str, source: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}, 2) AS {c}" for c in operational.SUM_FIELDS) + ", " + ", ".join(operational.RATIOS) + f" FROM {source}"


@query(f"{_DAILY_CTE} SELECT * FROM daily")
def operational_daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_facts(spark, sf)


@query(f"{_SUMMARY_CTE} {_tidy_sql('period, platform, days_observed', 'summary')}")
def operational_period_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(operational.summarize(daily_facts(spark, sf), PERIODS))


@query(f"""{_SUMMARY_CTE},
    c AS (SELECT coalesce(a.platform, b.platform) AS platform, a.orders AS bo, b.orders AS ao, a.paid_amount AS bp, b.paid_amount AS ap, a.paid_per_order AS bpo, b.paid_per_order AS apo,
        a.platform IS NOT NULL AND b.platform IS NOT NULL AS both_there FROM (SELECT * FROM summary WHERE period = '1996') a FULL JOIN (SELECT * FROM summary WHERE period = '1997') b ON a.platform = b.platform),
    e AS (SELECT *, (ao - bo) * (ap / ao + bp / bo) / 2 AS vol, (ap / ao - bp / bo) * (ao + bo) / 2 AS rate FROM c)
    SELECT platform, CASE WHEN both_there THEN 'comparable' ELSE 'not_comparable_missing_period' END AS comparison_status, round(bp, 2) AS before_paid_amount, round(ap, 2) AS after_paid_amount,
        round((ao - bo) / bo, 4) AS orders_change_pct, round((ap - bp) / bp, 4) AS paid_amount_change_pct, round((apo - bpo) / bpo, 4) AS paid_per_order_change_pct,
        round(vol, 2) AS volume_effect, round(rate, 2) AS paid_per_order_effect, round(ap - bp, 2) AS actual_change, abs(round(ap - bp - vol - rate, 2)) AS reconciliation_difference FROM e
""")
def operational_comparison_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    out = operational.compare_periods(operational.summarize(daily_facts(spark, sf), PERIODS), "1996", "1997")
    out = out.withColumns({c: F.round(c, 2) for c, k in out.dtypes if k == "double" and not c.endswith("_pct")})
    return out.withColumn("reconciliation_difference", F.abs("reconciliation_difference"))


@query(f"""{_SUMMARY_CTE},
    dd AS (SELECT DISTINCT period, business_date FROM pd WHERE period IS NOT NULL),
    h AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY business_date) AS i, count(*) OVER (PARTITION BY period) AS n FROM dd),
    h2 AS (SELECT period, business_date, CASE WHEN i <= n // 2 THEN 'early' ELSE 'late' END AS subphase FROM h WHERE n >= 4),
    sp AS (SELECT period, subphase, min(business_date) AS "start", max(business_date) AS "end" FROM h2 GROUP BY ALL),
    sx AS (SELECT h2.subphase, pd.* FROM pd JOIN h2 ON pd.period = h2.period AND pd.business_date = h2.business_date),
    s2 AS ({_block_sql("period, subphase, CASE WHEN grouping(platform) = 1 THEN '(all)' ELSE platform END AS platform")} FROM sx GROUP BY GROUPING SETS ((period, subphase, platform), (period, subphase))),
    s3 AS (SELECT s2.*, {_ratios_sql()}, "start", "end" FROM s2 JOIN sp ON s2.period = sp.period AND s2.subphase = sp.subphase)
    {_tidy_sql('period, subphase, platform, "start", "end"', "s3")}
""")
def operational_subphases(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(operational.subphases(daily_facts(spark, sf), PERIODS))


_MONTHLY = "SELECT date_trunc('month', business_date)::DATE AS business_date, * EXCLUDE (business_date) FROM daily"


@query(f"""{_DAILY_CTE}, mm AS ({_MONTHLY}),
    cb AS ({_block_sql("business_date, CASE WHEN grouping(platform) = 1 THEN '(all)' ELSE platform END AS platform")} FROM mm GROUP BY GROUPING SETS ((business_date, platform), (business_date))),
    cc AS (SELECT *, {_ratios_sql()} FROM cb),
    cl AS (SELECT business_date, platform, unnest([{{'metric': 'orders', 'v': orders}}, {{'metric': 'paid_amount', 'v': paid_amount}}, {{'metric': 'paid_per_order', 'v': paid_per_order}}, {{'metric': 'promo_spend', 'v': promo_spend}}], recursive := true) FROM cc),
    cs AS (SELECT platform, metric, lag(business_date) OVER w AS before_date, business_date AS candidate_date, (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) AS ch FROM cl WINDOW w AS (PARTITION BY platform, metric ORDER BY business_date))
    SELECT platform, metric, before_date, candidate_date, round(ch, 4) AS change_pct FROM cs WHERE abs(ch) >= 0.4
""")
def operational_change_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly facts, changes of 40 % or more."""
    monthly = daily_facts(spark, sf).withColumn("business_date", F.trunc("business_date", "month"))
    return operational.change_candidates(monthly, 0.4)


@query("""
    WITH d AS (SELECT DISTINCT o_orderpriority AS platform, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'),
    g AS (SELECT platform, lag(d) OVER (PARTITION BY platform ORDER BY d) AS gap_start, d AS gap_end FROM d)
    SELECT platform, gap_start, gap_end, gap_end - gap_start AS days_apart FROM g WHERE gap_end - gap_start > 1
""")
def date_gaps_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    of = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    days = table(spark, sf, "orders").join(of, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("platform"), F.to_date("o_orderdate").alias("business_date"))
    return operational.date_gaps(days)


@query(f"""{_DAILY_CTE} SELECT 'duplicate_platform_daily_key' AS code, business_date, platform FROM daily WHERE source_rows > 1
    UNION ALL SELECT 'implausible_units_per_order_candidate', business_date, platform FROM daily WHERE units / nullif(orders, 0) > 100""")
def operational_daily_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return operational.daily_warnings(daily_facts(spark, sf))


def _movement_sql(facts: str) -> str:
    return f"""
    WITH f AS ({facts}),
    g AS (SELECT entity_id, platform, count(*) FILTER (period = '1996') AS rb, count(*) FILTER (period = '1997') AS ra, round(sum(paid_amount) FILTER (period = '1996'), 4) AS paid_before,
        round(sum(paid_amount) FILTER (period = '1997'), 4) AS paid_after FROM f WHERE period IS NOT NULL GROUP BY ALL)
    SELECT entity_id, platform, round(paid_before, 2) AS paid_before, round(paid_after, 2) AS paid_after, round(CASE WHEN paid_before <> 0 THEN paid_after - paid_before END, 2) AS paid_amount_change,
        CASE WHEN rb = 0 THEN 'not_observed_before' WHEN ra = 0 THEN 'not_observed_after' ELSE 'observed_in_both_periods' END AS status, rb + ra AS source_rows_aggregated FROM g"""


_CUSTOMER_FACTS = f"""SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderpriority AS platform, {_PERIOD_SQL.replace("business_date", "CAST(o_orderdate AS DATE)")} AS period, o_totalprice AS paid_amount FROM orders"""


def customer_movements(spark: SparkSession, sf: str) -> DataFrame:
    o = order_facts(spark, sf).select(F.col("o_custkey").cast("string").alias("entity_id"), "platform", operational.period_of(F.col("business_date"), PERIODS).alias("period"), "paid_amount")
    out = operational.entity_movements(o, "1996", "1997")
    return out.withColumns({c: F.round(c, 2) for c in ("paid_before", "paid_after", "paid_amount_change")})


@query(_movement_sql(_CUSTOMER_FACTS))
def entity_movements_customer(spark: SparkSession, sf: str) -> DataFrame:
    return customer_movements(spark, sf)


@query(f"SELECT * FROM ({_movement_sql(_CUSTOMER_FACTS)}) WHERE status = 'observed_in_both_periods' ORDER BY abs(coalesce(paid_amount_change, 0)) DESC, entity_id, platform LIMIT 25")
def top_movements_customer(spark: SparkSession, sf: str) -> DataFrame:
    return operational.top_movements(customer_movements(spark, sf), 25)


_BRAND_FACTS = f"""SELECT p_brand AS entity_id, p_type AS platform, {_PERIOD_SQL.replace("business_date", "CAST(l_shipdate AS DATE)")} AS period, l_extendedprice AS paid_amount FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query(_movement_sql(_BRAND_FACTS))
def entity_movements_brand(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity_id"), F.col("p_type").alias("platform"))
    lines = table(spark, sf, "lineitem").select("l_partkey", operational.period_of(F.to_date("l_shipdate"), PERIODS).alias("period"), F.col("l_extendedprice").alias("paid_amount"))
    out = operational.entity_movements(lines.join(part, F.col("l_partkey") == F.col("p_partkey")), "1996", "1997")
    return out.withColumns({c: F.round(c, 2) for c in ("paid_before", "paid_after", "paid_amount_change")})


_COVERAGE = """SELECT event_type AS family, 'user' || (user_id % 7) AS unit, strftime(ts, '%Y-%m-%d') AS snapshot_date, count(*) AS row_count, count(nullif(round(value), 0)) AS valid_count,
    CASE WHEN max(value) > 40 THEN 'wide' ELSE 'narrow' END AS fingerprint FROM events GROUP BY ALL"""


def event_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("family"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("unit"), F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.nullif(F.round("value"), F.lit(0.0))).alias("valid_count"), F.when(F.max("value") > 40, "wide").otherwise("narrow").alias("fingerprint")
    )


@query(f"""SELECT family, unit, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(valid_count) AS BIGINT) AS valid_count, count(DISTINCT snapshot_date) AS snapshot_dates, min(snapshot_date) AS first_date,
    max(snapshot_date) AS last_date, array_to_string(list_sort(list(DISTINCT fingerprint)), ',') AS fingerprints FROM ({_COVERAGE}) GROUP BY ALL""")
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return operational.summarize_coverage(event_coverage(spark, sf))


@query(f"""WITH c AS ({_COVERAGE}), l AS (SELECT *, lag(fingerprint) OVER w AS f0, lag(row_count) OVER w AS n0 FROM c WINDOW w AS (PARTITION BY family, unit ORDER BY snapshot_date)),
    x AS (SELECT family, unit, snapshot_date, f0, fingerprint, (row_count - n0) / n0 AS ch FROM l)
    SELECT family, unit, snapshot_date, 'schema_changed' AS code, round(ch, 4) AS row_count_change FROM x WHERE f0 <> fingerprint
    UNION ALL SELECT family, unit, snapshot_date, 'row_count_jump', round(ch, 4) FROM x WHERE abs(ch) >= 0.5""")
def coverage_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return operational.coverage_breaks(event_coverage(spark, sf))


@query("""SELECT CAST(l_shipdate AS DATE) AS business_date, l_linestatus AS platform, l_returnflag AS flag, count(*) AS shipped, count(*) FILTER (l_quantity > 40) AS late,
    round(count(*) FILTER (l_quantity > 40) / count(*), 4) AS delay_rate FROM lineitem GROUP BY ALL""")
def optional_fulfilment_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("business_date"), F.col("l_linestatus").alias("platform"), F.col("l_returnflag").alias("flag"), F.lit(1).cast("long").alias("shipped"), (F.col("l_quantity") > 40).cast("long").alias("late"))
    return operational.optional_facts(rows, ["flag"])


# measurements

START, END = "2024-01-03", "2024-01-24"
_EVENTS_SQL = "(SELECT *, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25')"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("half", F.when(F.col("ts") < F.lit("2024-01-14").cast("timestamp_ntz"), "h1").otherwise("h2")).withColumn("is_error", (F.col("event_type") == "error").cast("string"))


def _measured(name: str, spec: dict, value: str, n: str = "count(*)", source: str = _EVENTS_SQL, text: str = "CAST(NULL AS VARCHAR)") -> None:
    sql = f"SELECT '{spec['kind']}' AS kind, round(CAST({value} AS DOUBLE), 6) AS value, {text} AS text, CAST({n} AS BIGINT) AS n, 'completed' AS status FROM {source} e"
    query(sql, f"measure_{name}")(lambda spark, sf: rounded(m.measure(_events(spark, sf), spec | {"order": ["event_id"]}, "ts", START, END)))


_VIEW, _CLICK = "avg(value) FILTER (event_type = 'view')", "avg(value) FILTER (event_type = 'click')"
_measured("count", {"kind": "count"}, "count(*)")
for _kind, _value in {
    "first": "arg_min(value, (ts, event_id))", "last": "arg_max(value, (ts, event_id))", "min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "sum": "sum(value)",
    "period_change": "arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))", "period_pct_change": "(arg_max(value, (ts, event_id)) / arg_min(value, (ts, event_id)) - 1) * 100",
}.items():
    _measured(_kind, {"kind": _kind, "field": "value"}, _value)
for _kind in ("date_of_min", "date_of_max", "time_of_min", "time_of_max"):
    _at = f"(SELECT ts FROM {_EVENTS_SQL} ORDER BY value {'ASC' if _kind.endswith('min') else 'DESC'}, ts LIMIT 1)"
    _measured(_kind, {"kind": _kind, "field": "value"}, "NULL", text=f"strftime({_at}, '{'%Y-%m-%d' if _kind.startswith('date') else '%Y-%m-%d %H:%M:%S.%f'}')")
_measured("max_drawdown_pct", {"kind": "max_drawdown_pct", "field": "value"}, "min(CASE WHEN peak <> 0 THEN (value / peak - 1) * 100 ELSE 0 END)", source=f"(SELECT *, max(value) OVER (ORDER BY ts, event_id) AS peak FROM {_EVENTS_SQL})")
_measured("proportion", {"kind": "proportion", "field": "value", "condition": {"operator": "gt", "value": 10}}, "avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END)")
_PAIR = {"group_field": "event_type", "group_a": "view", "group_b": "click"}
_IN_PAIR = "count(*) FILTER (event_type IN ('view', 'click'))"
_measured("group_mean_difference", {"kind": "group_mean_difference", "field": "value"} | _PAIR, f"{_VIEW} - {_CLICK}", _IN_PAIR)
_measured("group_median_difference", {"kind": "group_median_difference", "field": "value"} | _PAIR, "median(value) FILTER (event_type = 'view') - median(value) FILTER (event_type = 'click')", _IN_PAIR)
_measured("group_rate_difference", {"kind": "group_rate_difference", "field": "value", "condition": {"operator": "between", "value": [5, 20]}} | _PAIR,
          "avg(CASE WHEN value BETWEEN 5 AND 20 THEN 1.0 ELSE 0.0 END) FILTER (event_type = 'view') - avg(CASE WHEN value BETWEEN 5 AND 20 THEN 1.0 ELSE 0.0 END) FILTER (event_type = 'click')", _IN_PAIR)
_PHASED = f"(SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-14' THEN 'h1' ELSE 'h2' END AS half FROM {_EVENTS_SQL})"
_cell = lambda g, h: f"avg(value) FILTER (event_type = '{g}' AND half = '{h}')"
_measured("difference_in_differences", {"kind": "difference_in_differences", "field": "value", "group_field": "event_type", "treated_value": "view", "control_value": "click", "period_field": "half", "pre_value": "h1", "post_value": "h2"},
          f"({_cell('view', 'h2')} - {_cell('view', 'h1')}) - ({_cell('click', 'h2')} - {_cell('click', 'h1')})", source=_PHASED)
_measured("subgroup_difference_spread", {"kind": "subgroup_difference_spread", "field": "value", "subgroup_field": "half"} | _PAIR, "max(d) - min(d)", "sum(k)",
          f"(SELECT half, round({_VIEW} - {_CLICK}, 10) AS d, {_IN_PAIR} AS k FROM {_PHASED} GROUP BY half)")
_measured("lagged_pearson", {"kind": "lagged_pearson", "x_field": "value", "y_field": "user_id", "lag": 2}, "corr(value, y)", "count(y)",
          f"(SELECT value, lead(user_id, 2) OVER (ORDER BY ts, event_id) AS y FROM {_EVENTS_SQL} QUALIFY y IS NOT NULL)")
_measured("walk_forward_interval_mae", {"kind": "walk_forward_interval_mae", "event_field": "is_error", "minimum_history": 3}, "avg(abs(gap - predicted))", source=f"""
    (SELECT gap, predicted FROM (SELECT i, gap, quantile_cont(gap, 0.5) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted FROM
    (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, lead(day) OVER (ORDER BY ts, event_id) - day AS gap FROM {_EVENTS_SQL} WHERE event_type = 'error') WHERE gap IS NOT NULL) WHERE i >= 3)""")
_measured("rolling_origin_naive_mae", {"kind": "rolling_origin_naive_mae", "field": "value", "minimum_history": 3, "horizon": 2}, "avg(abs(value - later))", source=f"""
    (SELECT * FROM (SELECT value, lead(value, 2) OVER (ORDER BY ts) AS later, row_number() OVER (ORDER BY ts) AS i FROM {_EVENTS_SQL}) WHERE later IS NOT NULL AND i >= 3)""")


@query(f"""SELECT count(*) FILTER (ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '2024-01-25') AS inside, count(*) FILTER (ts < TIMESTAMP '{START}') AS before_window,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS after_window, count(*) FILTER (ts IS NULL) AS invalid_time FROM events""")
def window_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return m.window_diagnostics(table(spark, sf, "events"), "ts", START, END)


PREDICATES = {
    "gt": ("value > 12", 12), "gte": ("value >= 12", 12), "lt": ("value < 12", 12), "lte": ("value <= 12", 12), "eq": ("value = 12", 12), "neq": ("value <> 12", 12),
    "between": ("value BETWEEN 3 AND 12", [3, 12]), "outside": ("value NOT BETWEEN 3 AND 12", [3, 12]), "abs_lte": ("abs(value) <= 4", -4), "abs_gte": ("abs(value) >= 4", -4), "approx_eq": ("abs(value - 9) <= 0.5", 9),
}


@query("UNION ALL".join(f" SELECT '{k}' AS operator, count(*) FILTER ({sql}) AS matches, count(*) AS rows FROM events " for k, (sql, _) in PREDICATES.items()))
def predicate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.predicates import predicate
    from ..functions.types import strict_number_of

    events = table(spark, sf, "events")
    number = strict_number_of(events, "value")
    # one pass, one row: a row is not multiplied by the operators
    counts = events.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(predicate(F.col("value"), {"operator": k, "value": v, "tolerance": 0.5}, number)).alias(k) for k, (_, v) in PREDICATES.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("operator"), F.col(k).alias("matches"), F.col("rows").alias("rows")) for k in PREDICATES))))


# inference


def _segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("split", F.when(F.col("o_custkey") % 2 == 0, "discovery").otherwise("estimation"))


_SEGMENT_SQL = "(SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'discovery' ELSE 'estimation' END AS split FROM orders JOIN customer ON c_custkey = o_custkey)"


def _contrast_sql(where: str = "true", minimum: int = 30) -> str:
    return f"""SELECT split, c_mktsegment AS subgroup, na AS group_a_n, nb AS group_b_n, na >= {minimum} AND nb >= {minimum} AS ok, ma, mb, ma - mb AS d, sqrt(va / na + vb / nb) AS se FROM (
        SELECT split, c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb,
        var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM {_SEGMENT_SQL} WHERE {where} GROUP BY ALL)"""


@query(f"""SELECT subgroup, group_a_n, group_b_n, CASE WHEN ok THEN 'sufficient' ELSE 'insufficient' END AS support_status, round(ma, 4) AS group_a_mean, round(mb, 4) AS group_b_mean, round(d, 4) AS difference,
    round(se, 4) AS standard_error, round(d - 1.96 * se, 4) AS lower, round(d + 1.96 * se, 4) AS upper FROM ({_contrast_sql().replace("SELECT split, c_mktsegment, count", "SELECT 'x' AS split, c_mktsegment, count")})""")
def heterogeneity_prespecified(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.contrasts(_segment_rows(spark, sf), "c_mktsegment", "o_orderstatus", "F", "O", "o_totalprice", 30), 4)


@query(f"""SELECT count(*) AS eligible_subgroup_count, round(max(d) - min(d), 4) AS effect_spread, min(d) < 0 AND max(d) > 0 AS opposite_directions, 'completed' AS status
    FROM ({_contrast_sql().replace("SELECT split, c_mktsegment, count", "SELECT 'x' AS split, c_mktsegment, count")}) WHERE ok""")
def heterogeneity_spread(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.effect_spread(inference.contrasts(_segment_rows(spark, sf), "c_mktsegment", "o_orderstatus", "F", "O", "o_totalprice", 30)), 4)


@query(f"""WITH c AS ({_contrast_sql(minimum=10)}), f AS (SELECT subgroup, round(d, 10) AS dd FROM c WHERE split = 'discovery' AND ok AND abs(d) >= 500 ORDER BY abs(round(d, 10)) DESC, subgroup LIMIT 3)
    SELECT f.subgroup, round(dd, 4) AS discovery_difference, group_a_n, group_b_n, round(d, 4) AS difference, round(se, 4) AS standard_error, round(d - 1.96 * se, 4) AS lower, round(d + 1.96 * se, 4) AS upper,
        CASE WHEN sign(dd) = sign(d) AND (d - 1.96 * se > 0 OR d + 1.96 * se < 0) THEN 'confirmed' ELSE 'not_confirmed' END AS confirmation_status
    FROM f JOIN c ON c.subgroup = f.subgroup AND c.split = 'estimation'""")
def heterogeneity_honest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segment_rows(spark, sf)
    return rounded(inference.honest_contrasts(rows, "split", "discovery", "estimation", "c_mktsegment", "o_orderstatus", "F", "O", "o_totalprice", 10, 500, 3), 4)


@query("SELECT CAST(user_id AS BIGINT) AS unit FROM events GROUP BY user_id HAVING count(DISTINCT event_type = 'view') > 1")
def honest_split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A split that shares units, as the gate must find."""
    rows = table(spark, sf, "events").withColumn("split", F.when(F.col("event_type") == "view", "a").otherwise("b"))
    return inference.overlapping_units(rows, "user_id", "split", "a", "b")


MODELS = [inference.Model("m_last", "last_observation"), inference.Model("m_mean", "rolling_mean", 5), inference.Model("m_trend", "linear_trend"), inference.Model("m_season", "seasonal_naive", 7)]
_FORECAST_SQL = """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM d),
    f AS (SELECT i AS origin, day AS origin_time, lead(day, 2) OVER w AS target_time, lead(v, 2) OVER w AS observed, v AS m_last,
        CASE WHEN i >= 4 THEN avg(v) OVER (ORDER BY i ROWS 4 PRECEDING) END AS m_mean,
        coalesce(regr_intercept(v, i) OVER (ORDER BY i) + regr_slope(v, i) OVER (ORDER BY i) * (i + 2), v) AS m_trend, lag(v, 5) OVER w AS m_season FROM s WINDOW w AS (ORDER BY i)),
    k AS (SELECT * FROM f WHERE origin >= 7 AND observed IS NOT NULL AND m_mean IS NOT NULL AND m_season IS NOT NULL)"""


def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("at")).agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"{_FORECAST_SQL} SELECT origin, origin_time, target_time, round(observed, 5) AS observed, round(m_last, 5) AS m_last, round(m_mean, 5) AS m_mean, round(m_trend, 5) AS m_trend, round(m_season, 5) AS m_season FROM k")
def forecast_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.forecasts(daily_series(spark, sf), MODELS, 2, 8), 5)


@query(f"""{_FORECAST_SQL}, l AS (SELECT abs(m_last - observed) AS b, unnest([{{'model': 'm_last', 'e': abs(m_last - observed)}}, {{'model': 'm_mean', 'e': abs(m_mean - observed)}}, {{'model': 'm_trend', 'e': abs(m_trend - observed)}},
    {{'model': 'm_season', 'e': abs(m_season - observed)}}], recursive := true) FROM k), a AS (SELECT model, avg(e) AS sc, avg(b) AS bs, count(*) AS n, avg(b - e) AS g, count(*) FILTER (b - e > 0) AS w, count(*) FILTER (abs(b - e) <= 1e-12) AS t, count(*) FILTER (b - e < 0) AS lo FROM l GROUP BY model)
    SELECT model, round(sc, 5) AS score, CAST(row_number() OVER (ORDER BY round(sc, 10), model) AS INTEGER) AS rank, n AS origins, round((bs - sc) / bs, 5) AS relative_improvement, round(g, 5) AS mean_gain, w AS wins, t AS ties, lo AS losses FROM a""")
def forecast_competition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.scores(inference.forecasts(daily_series(spark, sf), MODELS, 2, 8), MODELS, "mae", "m_last"), 5)


@query()
def forecast_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the gain of the rolling mean on the last observation; draws are Python's, which SQL can't make."""
    found = inference.forecasts(daily_series(spark, sf), MODELS, 2, 8)
    gains = found.select("origin", (F.abs(F.col("m_last") - F.col("observed")) - F.abs(F.col("m_mean") - F.col("observed"))).alias("gain"))
    return inference.block_bootstrap_interval(gains, found.count(), 0.95, 500, 11, 3)


def _policy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Logged actions with known propensities; the target policy prefers views."""
    e = table(spark, sf, "events")
    p = F.when(F.col("event_type") == "view", 0.4).when(F.col("event_type") == "click", 0.3).otherwise(0.1)
    target = F.when(F.col("event_type") == "view", 0.6).when(F.col("event_type") == "click", 0.25).otherwise(0.05)
    return e.select("event_type", "user_id", F.col("value").alias("reward"), p.alias("p"), target.alias("t"), (F.col("user_id") % 10).cast("double").alias("q"))


_POLICY_SQL = """(SELECT user_id, value AS r, CASE event_type WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.3 ELSE 0.1 END::DOUBLE AS p, CASE event_type WHEN 'view' THEN 0.6 WHEN 'click' THEN 0.25 ELSE 0.05 END::DOUBLE AS t, (user_id % 10)::DOUBLE AS q FROM events)"""


@query(f"SELECT count(*) AS n, round(avg(t / p * r), 6) AS ips, round(sum(t / p * r) / sum(t / p), 6) AS snips, round(avg(q + 1 + t / p * (r - q)), 6) AS doubly_robust FROM {_POLICY_SQL}")
def ope_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = _policy_rows(spark, sf)
    return rounded(inference.policy_values(rows, inference.policy_weights(rows, "p", F.col("t")), "reward", "q", F.col("q") + 1))


@query(f"SELECT count(*) AS units, round(sum(w) ** 2 / sum(w * w), 6) AS effective_sample_size FROM (SELECT user_id, sum(t / p) AS w FROM {_POLICY_SQL} GROUP BY 1)")
def ope_effective_sample_size(spark: SparkSession, sf: str) -> DataFrame:
    rows = _policy_rows(spark, sf)
    return rounded(inference.cluster_sample_size(rows, inference.policy_weights(rows, "p", F.col("t")), "user_id"))


@query(f"""SELECT clip, floor, round(avg(w * r), 6) AS ips, round(sum(w * r) / sum(w), 6) AS snips FROM (SELECT clip, floor, r, least(t / greatest(p, floor), clip) AS w FROM {_POLICY_SQL},
    (SELECT unnest([0.8, 1.2, 5.0])::DOUBLE AS clip), (SELECT unnest([0.05, 0.2])::DOUBLE AS floor)) GROUP BY ALL""")
def ope_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.policy_sensitivity(_policy_rows(spark, sf), "p", F.col("t"), "reward", [0.8, 1.2, 5.0], [0.05, 0.2]))


@query()
def ope_unit_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the target policy's gain on the logging policy under resampled users."""
    rows = _policy_rows(spark, sf)
    return inference.unit_bootstrap(rows, "user_id", F.col("t") / F.col("p"), F.lit(1.0), "reward", 200, 5, 0.9)


@query("""WITH u AS (SELECT p_type AS action, count(*) AS scenarios, round(sum(w * net) / sum(w), 10) AS e, min(net) AS lo, max(net) AS hi FROM (SELECT p_type, 1.0 + p_size % 3 AS w, 0.5 * p_retailprice - 10 * p_size AS net FROM part) GROUP BY 1)
    SELECT action, scenarios, round(e, 6) AS expected_net_utility, round(lo, 6) AS minimum, round(hi, 6) AS maximum, e >= 300 AS eligible,
        row_number() OVER (ORDER BY (e >= 300) DESC, e DESC, action) = 1 AND max(e >= 300) OVER () OR (NOT max(e >= 300) OVER () AND action = 'ECONOMY') AS selected FROM u""")
def decision_utility(spark: SparkSession, sf: str) -> DataFrame:
    utilities = inference.expected_utility(table(spark, sf, "part"), "p_type", F.lit(0.5), F.col("p_retailprice"), 10.0 * F.col("p_size"), (1 + F.col("p_size") % 3).cast("double"))
    return rounded(inference.decide(utilities, 300.0, "ECONOMY"))


# statistics


@query("""SELECT coalesce(nullif(p_type, 'PROMO'), '(unclassified)') AS category, count(*) AS count, round(avg(p_retailprice), 1) AS mean, round(median(p_retailprice), 1) AS median, round(median(p_size / 50), 4) AS median_dependency FROM part GROUP BY 1""")
def category_summary_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.nullif("p_type", F.lit("PROMO")).alias("p_type"), "p_retailprice", (F.col("p_size") / 50).alias("dependency"))
    return statistics.category_summary(rows, "p_type", "p_retailprice", "dependency")


_FEATURES = {"is_red": "red", "has_ring": "ring", "is_small": "small"}


@query("UNION ALL".join(f""" SELECT '{k}' AS feature, a AS n_with, b AS n_without, ma AS median_with, mb AS median_without, CASE WHEN a >= 3 AND b >= 3 THEN round(ma / mb, 4) END AS median_ratio, a >= 3 AND b >= 3 AS eligible
    FROM (SELECT count(*) FILTER (p_name LIKE '%{w}%') AS a, count(*) FILTER (p_name NOT LIKE '%{w}%') AS b, median(p_retailprice) FILTER (p_name LIKE '%{w}%') AS ma, median(p_retailprice) FILTER (p_name NOT LIKE '%{w}%') AS mb FROM part) """ for k, w in _FEATURES.items()))  # fmt: skip
def title_feature_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import features

    rows = table(spark, sf, "part").select("p_retailprice", *features(F.col("p_name"), _FEATURES))
    return statistics.feature_contrasts(rows, list(_FEATURES), "p_retailprice")


@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS p75,
    round((SELECT sum(x) FROM (SELECT o_totalprice AS x FROM orders ORDER BY 1 DESC LIMIT 3)) / sum(o_totalprice), 6) AS top_share FROM orders""")
def distribution_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.distribution(table(spark, sf, "orders"), "o_totalprice")).withColumn("total", F.round("total", 2))


@query("SELECT event_type, round(sum(value), 2) AS total, count(*) AS rows, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1")
def channel_totals_events(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.channel_totals(table(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 2))


CHANNELS = ["view", "click", "purchase"]


@query("""SELECT user_id, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase,
    round(coalesce(max(value) FILTER (event_type = 'view'), 0) / nullif(coalesce(max(value) FILTER (event_type = 'view'), 0) + coalesce(max(value) FILTER (event_type = 'click'), 0) + coalesce(max(value) FILTER (event_type = 'purchase'), 0), 0), 4) AS dependency
    FROM events GROUP BY 1""")
def max_per_channel_events(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.max_per_channel(table(spark, sf, "events"), "user_id", "event_type", "value", CHANNELS)


@query("SELECT 'negative_or_zero' AS reason, count(*) AS rows FROM events WHERE value <= 0 HAVING count(*) > 0 UNION ALL SELECT 'errors', count(*) FROM events WHERE value > 0 AND event_type = 'error' HAVING count(*) > 0")
def eligibility_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.eligibility(table(spark, sf, "events"), {"negative_or_zero": F.col("value") <= 0, "errors": F.col("event_type") == "error"})[1]


@query("""SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_passed, count(*) AS checks, count(*) FILTER (o_totalprice <= 1000) AS failed, count(*) FILTER (o_totalprice <= 1000 AND o_orderstatus = 'F') AS critical_failed FROM orders GROUP BY 1""")
def conformance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") > 1000).alias("ok"), (F.col("o_orderstatus") == "F").alias("critical"))
    return statistics.conformance(rows, "o_orderpriority", "ok", "critical")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def event_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Global row numbers of a series, numbered day by day in parallel."""
    return series.with_ordinal(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], F.to_date("ts")).select("event_id", F.col("ordinal").cast("long"))
