"""Sinks that never touch a source and never leave half a result in sight."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SourceError


def guard(output: str, sources: list[str]) -> None:
    """Refuse an output that is, holds or lies in one of the sources."""
    out = output.rstrip("/")
    for s in sources:
        s = s.rstrip("/")
        if out == s or out.startswith(s + "/") or s.startswith(out + "/"):
            raise SourceError(f"output {output} would overwrite source {s}")


def write_csv(df: DataFrame, path: str, sources: list[str] | None = None) -> None:
    """Null as the empty text; an existing output is an error."""
    guard(path, sources or [])
    df.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_json_lines(df: DataFrame, path: str, sources: list[str] | None = None) -> None:
    guard(path, sources or [])
    df.write.mode("errorifexists").json(path)


def write_document(spark: SparkSession, payload: dict[str, Any], path: str, sources: list[str] | None = None) -> None:
    """A small JSON document, visible only when complete: written beside its place, then renamed."""
    guard(path, sources or [])
    fs_package = spark._jvm.org.apache.hadoop.fs
    final, hidden = fs_package.Path(path), fs_package.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise SourceError(f"{path} exists")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2).encode()))
    out.close()
    if not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise SourceError(f"{path} could not be committed")


def run_manifest(files: DataFrame, group: str) -> DataFrame:
    """(group, path, bytes, sha256): what binds a run's outputs to its inputs."""
    return files.select(F.lit(group).alias("group"), "path", "bytes", "sha256")


def verify_manifest(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing or changed since the manifest."""
    both = manifest.select("path", "sha256").join(now.select("path", F.col("sha256").alias("found")), "path", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")
