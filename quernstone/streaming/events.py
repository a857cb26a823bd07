"""Structured Streaming: windowed figures, sessions, running state, idempotent ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the parquet files below folder that match glob."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum of value in windows of width; windows close once the watermark has passed them."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = w.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return by.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: runs of events no more than gap apart."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = w.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch that brings events of the key; the state is two numbers for each key."""
    kind = dict(events.dtypes)[key]

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [name[0]], "n": [n], "total": [round(total, 4)]})

    return events.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def distinct_within(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first event of each key, remembered as long as the watermark allows."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there and stop. A batch that is run again replaces its own folder, so nothing counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key over all batches."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    by = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return by.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
