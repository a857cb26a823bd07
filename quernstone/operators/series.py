"""Running figures over one long ordered series, without one task that holds it all.

A series is cut into buckets by a range of its order (days, say). Inside a bucket
windows run in parallel; across buckets they run over one row for each bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def day_bucket(time: Column) -> Column:
    return F.to_date(time)


def with_ordinal(df: DataFrame, order: list[str | Column], bucket: Column, name: str = "ordinal") -> DataFrame:
    """df with each row's number from 0 in the given order; bucket must rise with the order's first column."""
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    numbered = cut.withColumn("_inside", inside).join(starts, "_bucket")
    return numbered.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")


def running(df: DataFrame, order: list[str], bucket: Column, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running sums ("sum") or maxima ("max") up to and with each row: {name: (kind, value)}."""
    cut = df.withColumn("_bucket", bucket)
    for name, (_, value) in columns.items():
        cut = cut.withColumn(f"_v_{name}", value)
    kinds = {"sum": F.sum, "max": F.max}
    whole = cut.groupBy("_bucket").agg(*(kinds[k](f"_v_{n}").alias(f"_w_{n}") for n, (k, _) in columns.items()))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_bucket", *(kinds[k](f"_w_{n}").over(before).alias(f"_s_{n}") for n, (k, _) in columns.items()))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.select("*", *(kinds[k](f"_v_{n}").over(inside).alias(f"_i_{n}") for n, (k, _) in columns.items())).join(starts, "_bucket")
    for name, (kind, _) in columns.items():
        both = F.coalesce(F.col(f"_i_{name}") + F.col(f"_s_{name}"), f"_i_{name}", f"_s_{name}") if kind == "sum" else F.greatest(f"_i_{name}", f"_s_{name}")
        out = out.withColumn(name, both)
    return out.drop("_bucket", *(f"_{p}_{n}" for p in "vsi" for n in columns))


def shifted(df: DataFrame, ordinal: str, by: int, columns: dict[str, str]) -> DataFrame:
    """df joined with the rows by places later (earlier if negative): {new name: column}; inner."""
    later = df.select((F.col(ordinal) - by).alias(ordinal), *(F.col(c).alias(n) for n, c in columns.items()))
    return df.join(later, ordinal)


def numbered(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """df with each row's number from 0 in any total order: buckets are ranges that Spark cuts by a sample of the order's columns.

    Rows with their buckets are written once, as another sample would cut them elsewhere.
    """
    cut = materialize(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()), "ordinals")
    return with_ordinal(cut, order, F.col("_bucket"), name)


#: Rows of a block of an expanding median.
MEDIAN_BLOCK = 4096


def expanding_median(rows: DataFrame, ordinal: str, value: str, name: str) -> DataFrame:
    """ordinal, value and the median of all values of smaller ordinals (null for none), for values with few different ones.

    A block of ordinals gets the counts of the different values before it and adds
    its own rows one after another. Ordinals are whole numbers from 0, each once.
    """
    cut = materialize(rows.select(F.floor(F.col(ordinal) / MEDIAN_BLOCK).alias("block"), F.col(ordinal).alias("at"), F.col(value).cast("double").alias("v")), "median-blocks")
    last = cut.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    by_value = Window.partitionBy("v").orderBy("block")
    counts = cut.groupBy("v", "block").agg(F.count(F.lit(1)).alias("n"))
    # what a value has come to after a block holds until the block in which it comes again
    since = counts.select("v", "block", F.sum("n").over(by_value).alias("upto"), F.coalesce(F.lead("block").over(by_value), F.lit(last)).alias("until"))
    before = since.filter("until > block").select(F.explode(F.sequence(F.col("block") + 1, F.col("until"))).alias("block"), F.lit(None).cast("long").alias("at"), "v", "upto")
    both = cut.select("block", F.col("at").cast("long"), "v", F.lit(None).cast("long").alias("upto")).unionByName(before)

    def medians(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["at"].notna()].sort_values("at")
        values = np.unique(part["v"].to_numpy())
        times = np.zeros(len(values), np.int64)
        held = part[part["at"].isna()]
        times[np.searchsorted(values, held["v"].to_numpy())] = held["upto"].to_numpy().astype(np.int64)
        found, total = np.full(len(own), np.nan), int(times.sum())
        for k, place in enumerate(np.searchsorted(values, own["v"].to_numpy())):
            if total:
                low, high = np.searchsorted(np.cumsum(times), [(total - 1) // 2, total // 2], side="right")
                found[k] = (values[low] + values[high]) / 2
            times[place] += 1
            total += 1
        return pd.DataFrame({"at": own["at"].astype("int64"), "v": own["v"], "median": found})

    out = both.groupBy("block").applyInPandas(medians, "at long, v double, median double")
    return out.select(F.col("at").alias(ordinal), F.col("v").alias(value), F.nanvl("median", F.lit(None)).alias(name))


#: Cuts of the distinct values of a group, between which its quantiles are looked for.
CUTS = 64


def exact_quantiles(values: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """keys and the named quantiles, by linear interpolation, of distinct values with weights; no task holds a group's values.

    Approximate quantiles cut each group into ranges, whose weights tell which of
    them hold the wanted ranks; only those ranges are then sorted. Groups are few
    (columns, say): their cuts are broadcast. values is read three times.
    """
    real = values.filter(F.col(value).isNotNull()).select(*keys, F.lit(0).alias("_one"), F.col(value).alias("_v"), F.col(weight).alias("_n"))
    by = [*keys, "_one"]
    cuts = real.groupBy(*by).agg(F.percentile_approx("_v", [k / CUTS for k in range(1, CUTS)], 1000).alias("_cuts"), F.sum("_n").alias("_total"))
    # how many cuts are below the value, by halving
    cut = real.join(F.broadcast(cuts), by).withColumn("_range", F.lit(0))
    step = CUTS // 2
    while step:
        cut = cut.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (step - 1)) < F.col("_v"), step).otherwise(0))
        step //= 2
    cut = cut.drop("_cuts")
    sizes = cut.groupBy(*by, "_range", "_total").agg(F.sum("_n").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(*by).orderBy("_range"))
    place = lambda p: F.lit(p) * (F.col("_total") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()))))
    held = sizes.withColumn("_upto", upto).select(*by, "_range", (F.col("_upto") - F.col("_size")).alias("_before"), "_upto", ranks.alias("_ranks"))
    held = held.filter(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))).select(*by, "_range", "_before")
    through = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    sorted_ = cut.join(F.broadcast(held), [*by, "_range"]).withColumn("_through", through)
    at = lambda rank: F.max(F.when((rank < F.col("_through")) & (rank >= F.col("_through") - F.col("_n")), F.col("_v")))
    picked = sorted_.groupBy(*by, "_total").agg(*(x for k, p in enumerate(shares.values()) for x in (at(F.floor(place(p))).alias(f"_l{k}"), at(F.ceil(place(p))).alias(f"_h{k}"))))

    def between(k: int, p: float) -> Column:
        low, high = F.col(f"_l{k}"), F.col(f"_h{k}")
        return F.when(low == high, low).otherwise((F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high)

    return picked.select(*keys, *(between(k, p).alias(name) for k, (name, p) in enumerate(shares.items())))
