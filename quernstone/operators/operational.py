"""Operational comparison: daily facts, periods, exact decomposition, movements, coverage.

Facts are (day, platform, six sums). Sums of no valid value stay null; ratios are
taken from already rounded sums; an entity absent from a period is not observed,
never zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import lenient_number, pct_change, ratio

SUM_FIELDS = ("orders", "paid_amount", "refund_amount", "promo_spend", "units", "after_sale_orders")
RATIOS = {"paid_per_order": ("paid_amount", "orders"), "refund_rate_on_paid": ("refund_amount", "paid_amount"), "promo_to_paid_ratio": ("promo_spend", "paid_amount")}
CHANGE_METRICS = ("orders", "paid_amount", "paid_per_order", "promo_spend")
DIGITS = 4
ALL = "(all)"


@dataclass(frozen=True)
class Period:
    id: str
    start: str
    end: str


def rounded(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def block_sums() -> list[Column]:
    """The six rounded sums; Spark's sum is null exactly if no value is valid."""
    return [rounded(F.sum(f)).alias(f) for f in SUM_FIELDS]


def with_ratios(df: DataFrame) -> DataFrame:
    """The three ratios of already rounded sums."""
    return df.select("*", *(rounded(ratio(F.col(a), F.col(b))).alias(name) for name, (a, b) in RATIOS.items()))


def fact_errors(rows: DataFrame) -> DataFrame:
    """(error, n) over raw rows of business_date, platform and sums: missing keys, invalid dates, negative figures."""
    present = F.col("business_date").isNotNull() & (F.trim(F.col("platform")) != "")
    negative = [F.when(F.col(f) < 0, F.lit(f"negative_{f}")) for f in SUM_FIELDS]
    found = F.array_compact(F.array(F.when(~F.coalesce(present, F.lit(False)), F.lit("missing_required")), *negative))
    return rows.select(F.explode(found).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def aggregate_daily(rows: DataFrame) -> DataFrame:
    """One row for each (business_date, platform): rounded sums, ratios, and how many source rows met (over 1 is an error)."""
    numbers = rows.select(F.to_date("business_date").alias("business_date"), F.trim("platform").alias("platform"), *(lenient_number(F.col(f)).alias(f) if dict(rows.dtypes)[f] == "string" else F.col(f).cast("double").alias(f) for f in SUM_FIELDS))
    keyed = numbers.filter(F.col("business_date").isNotNull() & (F.col("platform") != ""))
    return with_ratios(keyed.groupBy("business_date", "platform").agg(F.count(F.lit(1)).alias("source_rows"), *block_sums()))


def daily_warnings(daily: DataFrame) -> DataFrame:
    """Duplicate daily keys and more than 100 units an order."""
    per_order = ratio(F.col("units"), F.col("orders"))
    found = F.array_compact(F.array(F.when(F.col("source_rows") > 1, F.lit("duplicate_platform_daily_key")), F.when(per_order > 100, F.lit("implausible_units_per_order_candidate"))))
    return daily.select(F.explode(found).alias("code"), "business_date", "platform")


def date_gaps(daily: DataFrame) -> DataFrame:
    """Consecutive observed days of a platform that lie more than a day apart."""
    days = daily.select("platform", "business_date").distinct()
    before = F.lag("business_date").over(Window.partitionBy("platform").orderBy("business_date"))
    gaps = days.withColumn("gap_start", before).filter(F.datediff("business_date", "gap_start") > 1)
    return gaps.select("platform", "gap_start", F.col("business_date").alias("gap_end"), F.datediff("business_date", "gap_start").cast("long").alias("days_apart"))


def midpoint_periods(daily: DataFrame) -> list[Period]:
    """Two periods that halve the observed days; one row of aggregates is read."""
    days = daily.select("business_date").distinct()
    # the middle by count: days of a calendar are few, and their order needs one window over them
    number = days.select("business_date", F.row_number().over(Window.orderBy("business_date")).alias("i"))
    n = days.count()
    if not n:
        return []
    cut = max(1, n // 2)
    first = number.agg(F.min("business_date"), F.max(F.when(F.col("i") <= cut, F.col("business_date"))), F.min(F.when(F.col("i") > cut, F.col("business_date"))), F.max("business_date")).first()
    out = [Period("period_1", str(first[0]), str(first[1]))]
    return out + ([Period("period_2", str(first[2]), str(first[3]))] if n > cut else [])


def check_periods(periods: list[Period]) -> list[str]:
    """Errors: an end before its start, and periods that overlap."""
    out = [f"invalid_period:{p.id}" for p in periods if p.start > p.end]
    return out + [f"overlapping_periods:{a.id}:{b.id}" for i, a in enumerate(periods) for b in periods[i + 1 :] if a.start <= b.end and b.start <= a.end]


def period_of(day: Column, periods: list[Period]) -> Column:
    """The first declared period that holds the day; a literal CASE, so no join is needed."""
    out = F.lit(None).cast("string")
    for p in reversed(periods):
        out = F.when(day.between(F.to_date(F.lit(p.start)), F.to_date(F.lit(p.end))), F.lit(p.id)).otherwise(out)
    return out


def summarize(daily: DataFrame, periods: list[Period]) -> DataFrame:
    """Metric block and observed days by (period, platform), and over all platforms, in one pass of grouping sets."""
    placed = daily.select(period_of(F.col("business_date"), periods).alias("period"), "platform", "business_date", *SUM_FIELDS).filter("period is not null")
    sets = placed.groupingSets([["period", "platform"], ["period"]], "period", "platform")
    out = sets.agg(F.grouping("platform").alias("whole"), F.count_distinct("business_date").alias("days_observed"), *block_sums())
    return with_ratios(out.withColumn("platform", F.when(F.col("whole") == 1, F.lit(ALL)).otherwise(F.col("platform"))).drop("whole"))


def compare_periods(summary: DataFrame, first: str, second: str) -> DataFrame:
    """Both periods side by side, changes, and the symmetric volume and rate effects on the paid amount."""
    names = [*SUM_FIELDS, "paid_per_order"]
    side = lambda period, tag: summary.filter(F.col("period") == period).select("platform", F.lit(True).alias(f"has_{tag}"), *(F.col(c).alias(f"{tag}_{c}") for c in names))
    both = side(first, "before").join(side(second, "after"), "platform", "full_outer")
    comparable = F.coalesce(F.col("has_before") & F.col("has_after"), F.lit(False))
    b_orders, a_orders, b_paid, a_paid = (F.col(c) for c in ("before_orders", "after_orders", "before_paid_amount", "after_paid_amount"))
    b_rate, a_rate = ratio(b_paid, b_orders), ratio(a_paid, a_orders)
    volume, rate = (a_orders - b_orders) * (a_rate + b_rate) / 2, (a_rate - b_rate) * (a_orders + b_orders) / 2
    actual = F.when(volume.isNotNull(), a_paid - b_paid)
    out = both.select(
        "platform",
        F.when(comparable, "comparable").otherwise("not_comparable_missing_period").alias("comparison_status"),
        b_paid, a_paid,
        *(rounded(pct_change(F.col(f"before_{c}"), F.col(f"after_{c}"))).alias(f"{c}_change_pct") for c in ("orders", "paid_amount", "paid_per_order")),
        rounded(volume).alias("volume_effect"),
        rounded(rate).alias("paid_per_order_effect"),
        rounded(actual).alias("actual_change"),
        rounded(actual - volume - rate).alias("reconciliation_difference"),
    )
    return out


def subphases(daily: DataFrame, periods: list[Period], minimum_days: int = 4) -> DataFrame:
    """Early and late half of each period's observed days, by platform and over all."""
    placed = daily.select(period_of(F.col("business_date"), periods).alias("period"), "platform", "business_date", *SUM_FIELDS).filter("period is not null")
    days = placed.select("period", "business_date").distinct()
    number = F.row_number().over(Window.partitionBy("period").orderBy("business_date"))
    size = F.count(F.lit(1)).over(Window.partitionBy("period"))
    halves = days.select("period", "business_date", number.alias("i"), size.alias("days")).filter(F.col("days") >= minimum_days)
    halves = halves.withColumn("subphase", F.when(F.col("i") <= F.floor(F.col("days") / 2), "early").otherwise("late"))
    spans = halves.groupBy("period", "subphase").agg(F.min("business_date").alias("start"), F.max("business_date").alias("end"))
    joined = placed.join(halves.select("period", "business_date", "subphase"), ["period", "business_date"])
    sets = joined.groupingSets([["period", "subphase", "platform"], ["period", "subphase"]], "period", "subphase", "platform")
    out = sets.agg(F.grouping("platform").alias("whole"), *block_sums())
    out = out.withColumn("platform", F.when(F.col("whole") == 1, F.lit(ALL)).otherwise(F.col("platform"))).drop("whole")
    return with_ratios(out).join(spans, ["period", "subphase"])


def change_candidates(daily: DataFrame, threshold: float) -> DataFrame:
    """Changes of a threshold or more between consecutive observed days, by platform and over all."""
    sets = daily.groupingSets([["business_date", "platform"], ["business_date"]], "business_date", "platform")
    blocks = with_ratios(sets.agg(F.grouping("platform").alias("whole"), *block_sums()))
    blocks = blocks.withColumn("platform", F.when(F.col("whole") == 1, F.lit(ALL)).otherwise(F.col("platform")))
    long = blocks.unpivot(["business_date", "platform"], list(CHANGE_METRICS), "metric", "value")
    order = Window.partitionBy("platform", "metric").orderBy("business_date")
    steps = long.select("platform", "metric", F.lag("business_date").over(order).alias("before_date"), F.col("business_date").alias("candidate_date"), pct_change(F.lag("value").over(order), F.col("value")).alias("change"))
    return steps.filter(F.abs("change") >= threshold).select("platform", "metric", "before_date", "candidate_date", rounded(F.col("change")).alias("change_pct"))


def entity_movements(facts: DataFrame, first: str, second: str) -> DataFrame:
    """facts (entity_id, platform, period, paid_amount): both periods of each entity and platform, and its status."""
    sound = facts.filter((F.trim(F.col("entity_id").cast("string")) != "") & F.col("platform").isNotNull() & F.col("period").isin(first, second))
    pick = lambda p: F.col("period") == p
    # one shuffle: both periods of a key are conditional sums of the same group
    both = sound.groupBy("entity_id", "platform").agg(
        F.count(F.when(pick(first), F.lit(1))).alias("rows_before"), F.count(F.when(pick(second), F.lit(1))).alias("rows_after"),
        rounded(F.sum(F.when(pick(first), F.col("paid_amount")))).alias("paid_before"), rounded(F.sum(F.when(pick(second), F.col("paid_amount")))).alias("paid_after"),
    )
    status = F.when(F.col("rows_before") == 0, "not_observed_before").when(F.col("rows_after") == 0, "not_observed_after").otherwise("observed_in_both_periods")
    change = F.when((F.col("paid_before") != 0) & (status == "observed_in_both_periods"), F.col("paid_after") - F.col("paid_before"))
    return both.select("entity_id", "platform", "paid_before", "paid_after", rounded(change).alias("paid_amount_change"), status.alias("status"), (F.col("rows_before") + F.col("rows_after")).alias("source_rows_aggregated"))


def top_movements(movements: DataFrame, n: int) -> DataFrame:
    """The n largest absolute changes among entities seen in both periods; an unknown change ranks as zero."""
    return movements.filter("status = 'observed_in_both_periods'").orderBy(F.desc(F.abs(F.coalesce("paid_amount_change", F.lit(0.0)))), "entity_id", "platform").limit(n)


def summarize_coverage(coverage: DataFrame) -> DataFrame:
    """coverage (family, unit, snapshot_date, row_count, valid_count, fingerprint): totals by family and unit."""
    return coverage.groupBy("family", "unit").agg(
        F.sum("row_count").alias("row_count"), F.sum("valid_count").alias("valid_count"), F.count_distinct("snapshot_date").alias("snapshot_dates"),
        F.min("snapshot_date").alias("first_date"), F.max("snapshot_date").alias("last_date"), F.array_join(F.sort_array(F.collect_set("fingerprint")), ",").alias("fingerprints"),
    )


def coverage_breaks(coverage: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Changes of schema fingerprint, and jumps of the row count by threshold or more, between snapshots."""
    order = Window.partitionBy("family", "unit").orderBy(F.coalesce("snapshot_date", F.lit("")))
    last = coverage.select("*", F.lag("fingerprint").over(order).alias("f0"), F.lag("row_count").over(order).alias("n0"))
    change = pct_change(F.col("n0").cast("double"), F.col("row_count").cast("double"))
    codes = F.array_compact(F.array(F.when(F.col("f0") != F.col("fingerprint"), "schema_changed"), F.when(F.abs(change) >= threshold, "row_count_jump")))
    return last.select("family", "unit", "snapshot_date", F.explode(codes).alias("code"), rounded(change).alias("row_count_change"))


def optional_facts(facts: DataFrame, dims: list[str]) -> DataFrame:
    """Optional families by (business_date, platform, dims): sums of total and late, and delay_rate."""
    out = facts.groupBy("business_date", "platform", *dims).agg(F.sum("shipped").alias("shipped"), F.sum("late").alias("late"))
    return out.withColumn("delay_rate", rounded(ratio(F.col("late").cast("double"), F.col("shipped").cast("double"))))


def quality_gate(errors: DataFrame, warnings: DataFrame) -> str:
    """fail with any error, pass_with_warnings with any warning, else pass."""
    return "pass" if warnings.isEmpty() and errors.isEmpty() else "pass_with_warnings" if errors.isEmpty() else "fail"
