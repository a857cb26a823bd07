"""Session settings that the operators' semantics rely on."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "quernstone", **extra: str) -> SparkSession:
    """A session with SETTINGS; extra overrides them. Sizes of memory and shuffle are the cluster's."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | extra).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Text bytes and rows of a batch that a Python step works on at once; a longer text is one step.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def bounded_slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """batch in slices, so that the objects a step makes of them don't grow with what Spark puts into a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    marks = np.cumsum(sizes) // SLICE_BYTES + np.arange(len(sizes)) // SLICE_ROWS
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    for a, b in pairwise(cuts):
        if b > a:
            yield batch.slice(a, b - a)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for name that all executors share, below spark.checkpoint.dir; a local session without one, as in tests, gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/quernstone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quernstone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later passes read it, and lost executors don't undo it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
