"""Shared pieces of the training-data operators.

Words everywhere are maximal runs of bytes other than space and ``\\t``..``\\r``
in the UTF-8 text: ``bytes.split()`` splits at exactly those, and
``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes that one numpy step looks at; a longer single text is one step.
SLICE_BYTES = 1 << 20

#: Most bytes of a batch sent to Python, where the session leaves Spark's default: a batch is held several times on its way.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches for Python small in a session that doesn't set their size itself; results don't depend on it."""
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir; a local session without one, as in tests, gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/quernstone-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quernstone"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Delete at the end what materialize() has written inside, but for what is marked to stay."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def materialize(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes and not stays:
        _scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as a struct; names may hold dots and backticks."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most limit bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += size
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number, as int64 where values are integers."""
    out = np.bincount(rows, weights=values, minlength=n)
    return out if values.dtype.kind == "f" else np.rint(out).astype(np.int64)
