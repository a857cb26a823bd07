"""Category summaries, feature contrasts, distributions and channel figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .series import exact_quantiles

UNCLASSIFIED = "(unclassified)"


def _with_quantiles(by: DataFrame, rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by with exact quantiles of each of its few groups: values are counted first, and no task holds a group's values."""
    counts = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_times"))
    return by.join(exact_quantiles(materialize(counts, "quantile-values"), keys, "_v", "_times", shares), keys, "left")


def eligibility(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that no reason excludes, and (reason, rows) of the first reason that excludes each other row."""
    why = F.lit(None).cast("string")
    for name, excluded in reversed(reasons.items()):
        why = F.when(F.coalesce(excluded, F.lit(False)), F.lit(name)).otherwise(why)
    marked = df.withColumn("_why", why)
    return marked.filter("_why is null").drop("_why"), marked.filter("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def category_summary(df: DataFrame, key: str, value: str, dependency: str) -> DataFrame:
    """Count, mean, median and median dependency by category, the highest median first."""
    rows = df.select(F.coalesce(F.col(key), F.lit(UNCLASSIFIED)).alias("category"), F.col(value).alias("_value"), F.col(dependency).alias("_dependency"))
    by = rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("_value"), 1).alias("mean"))
    by = _with_quantiles(_with_quantiles(by, rows, ["category"], "_value", {"median": 0.5}), rows, ["category"], "_dependency", {"median_dependency": 0.5})
    by = by.withColumn("median", F.round("median", 1)).withColumn("median_dependency", F.round("median_dependency", 4))
    return by.orderBy(F.desc("median"), "category")


def feature_contrasts(df: DataFrame, features: list[str], value: str, minimum: int = 3) -> DataFrame:
    """Medians with and without each boolean feature, their ratio, and whether both groups are large enough."""
    long = df.select(value, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("flag")) for f in features))).alias("x"))
    by = long.groupBy(F.col("x.feature").alias("feature")).agg(
        F.count_if(F.col("x.flag")).alias("n_with"), F.count_if(~F.col("x.flag")).alias("n_without")
    )
    for name, held in (("median_with", F.col("x.flag")), ("median_without", ~F.col("x.flag"))):
        by = _with_quantiles(by, long.filter(held).select(F.col("x.feature").alias("feature"), value), ["feature"], value, {name: 0.5})
    enough = (F.col("n_with") >= minimum) & (F.col("n_without") >= minimum)
    return by.select("feature", "n_with", "n_without", "median_with", "median_without", F.when(enough, F.round(F.try_divide("median_with", "median_without"), 4)).alias("median_ratio"), enough.alias("eligible"))


def distribution(df: DataFrame, value: str, top: int = 3) -> DataFrame:
    """One row: count, sum, quartiles, and the share of the top few values."""
    # the top values come from a bounded heap in every task, not from a global sort
    highest = df.select(F.col(value).cast("double").alias("v")).orderBy(F.desc("v")).limit(top).agg(F.sum("v").alias("v"))
    one = df.agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    one = _with_quantiles(one.withColumn("_all", F.lit(0)), df.withColumn("_all", F.lit(0)), ["_all"], value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return one.select("n", "total", "p25", "median", "p75", F.round(F.try_divide(highest.scalar(), F.col("total")), 6).alias("top_share"))


def channel_totals(df: DataFrame, channel: str, value: str) -> DataFrame:
    """Sum and share of every channel."""
    by = df.groupBy(channel).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
    return by.select(channel, "total", "rows", F.round(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())), 6).alias("share"))


def max_per_channel(df: DataFrame, key: str, channel: str, value: str, channels: list[str]) -> DataFrame:
    """The maximum of each channel as columns (a fixed list, so no pass to find them), and the first one's share of all."""
    wide = df.groupBy(key).pivot(channel, channels).agg(F.max(value))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in channels), F.lit(0.0))
    return wide.withColumn("dependency", F.round(F.try_divide(F.coalesce(F.col(f"`{channels[0]}`"), F.lit(0.0)), total), 4))


def conformance(checks: DataFrame, dimension: str, passed: str, critical: str) -> DataFrame:
    """Every dimension passes only as a whole; failures that are critical are counted."""
    return checks.groupBy(dimension).agg(F.bool_and(passed).alias("all_passed"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col(passed)).alias("failed"), F.count_if(~F.col(passed) & F.col(critical)).alias("critical_failed"))
