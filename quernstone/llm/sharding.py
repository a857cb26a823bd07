"""Immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as runs of small files that never change. Once enough runs
are of similar size, they are merged, without a shuffle, into files of about the
target size. The state is a manifest that lists the files of every run; a new
version becomes visible by one atomic rename that fails if another writer has
committed that version, so readers see one version or the next, nothing between.

Defined cases: an arrival without rows commits a version and no run; null
columns, empty and long texts, repeated rows and any columns are stored as they
are; a lost commit race raises CommitConflict and leaves unreferenced files,
which vacuum() removes
when they are old enough to belong to no running writer. An arrival must have the
stored columns in their types. A job that lost executors is retried by Spark before
anything is committed.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
#: Runs of one tier that are merged together, and the size ratio between tiers.
FANOUT = 4
SMALLEST_BYTES = 1 << 20
#: Age from which a run that no version lists counts as abandoned.
GRACE_SECONDS = 24 * 3600


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class Run:
    """Files written together: (path below the root, bytes)."""

    name: str
    files: list[tuple[str, int]]

    @property
    def size(self) -> int:
        return sum(n for _, n in self.files)


@dataclass
class Manifest:
    version: int
    schema: str
    runs: list[Run] = field(default_factory=list)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, smallest_bytes: int = SMALLEST_BYTES):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target_bytes, fanout, smallest_bytes
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list:
        return list(self._fs.listStatus(self._path(name))) if self._fs.exists(self._path(name)) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self._list("manifests") if (n := s.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The named version, or the latest; version 0 is the empty state."""
        versions = self.versions()
        if not versions:
            return Manifest(0, "")
        at = version if version is not None else versions[-1]
        with_text = self.spark.read.text(f"{self.root}/manifests/v{at:012d}.json", wholetext=True).first()
        data = json.loads(with_text[0])
        return Manifest(data["version"], data["schema"], [Run(r["name"], [tuple(f) for f in r["files"]]) for r in data["runs"]])

    def _commit(self, base: Manifest, runs: list[Run], schema: str) -> Manifest:
        new = Manifest(base.version + 1, schema, runs)
        hidden, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{new.version:012d}.json")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(final), none)
        except Exception as error:
            self._fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {new.version}") from error
            raise
        return new

    def _write(self, df: DataFrame) -> Run | None:
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/data/{name}")
        files = [(f"data/{name}/{s.getPath().getName()}", s.getLen()) for s in self._list(f"data/{name}") if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{name}")
        return Run(name, files) if files and not rows.isEmpty() else None

    def append(self, arrival: DataFrame) -> Manifest:
        """Commit the rows as a new run. The arrival has every stored column in its type; columns that it adds are null in older rows."""
        base = self.manifest()
        schema = arrival.schema
        if base.schema:
            stored = T.StructType.fromJson(json.loads(base.schema))
            types = {f.name: f.dataType for f in schema}
            wrong = [f.name for f in stored if types.get(f.name) != f.dataType]
            if wrong:
                raise ValueError(f"the arrival lacks stored columns or changes their types: {', '.join(wrong)}")
            schema = T.StructType([*stored, *(f for f in schema if f.name not in stored.names)])
        run = self._write(arrival)
        return self._commit(base, base.runs + ([run] if run else []), schema.json())

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.size, 1) / self.smallest, self.fanout)))

    def full(self, run: Run) -> bool:
        """Whether the run's files are of the target size already, but for the last."""
        return run.size >= self.target and run.size / len(run.files) >= self.target / 2

    def compact(self) -> Manifest:
        """Merge runs of one tier, fanout of them or more, until no tier has so many; each merge is a commit."""
        while True:
            base = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for run in base.runs:
                if not self.full(run):
                    tiers.setdefault(self.tier(run), []).append(run)
            due = [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not due:
                return base
            merged = due[0][: self.fanout]
            total = sum(r.size for r in merged)
            run = self._write(self._rows(base, merged).coalesce(max(1, round(total / self.target))))
            gone = {r.name for r in merged}
            self._commit(base, [r for r in base.runs if r.name not in gone] + ([run] if run else []), base.schema)

    def _rows(self, manifest: Manifest, runs: list[Run]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        paths = [f"{self.root}/{f}" for r in runs for f, _ in r.files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        return self._rows(manifest, manifest.runs)

    def read_placed(self, version: int | None = None) -> DataFrame:
        """row (a struct of the stored columns), shard (number of the run), tier and version."""
        manifest = self.manifest(version)
        rows = self._rows(manifest, manifest.runs)
        run = F.regexp_extract(F.col("_metadata.file_path"), "/(run-[0-9a-f]+)/", 1) if manifest.runs else F.lit("")
        names = F.create_map(*(F.lit(x) for k, r in enumerate(manifest.runs or [Run("", [])]) for x in (r.name, k)))
        tiers = F.array(*(F.lit(self.tier(r)) for r in manifest.runs or [Run("", [])]))
        placed = rows.select(F.struct(*rows.columns).alias("row"), names[run].alias("shard"))
        return placed.select("row", "shard", F.get(tiers, F.col("shard")).alias("tier"), F.lit(manifest.version).cast("long").alias("version"))

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> None:
        """Delete runs that only versions before the last keep list, and those versions' manifests.

        A run that no version lists may belong to a writer that is about to commit;
        it goes once it is older than grace_seconds.
        """
        versions = self.versions()
        wanted = {r.name for v in versions[-keep:] for r in self.manifest(v).runs}
        retired = {r.name for v in versions[:-keep] for r in self.manifest(v).runs} - wanted
        oldest = (time.time() - grace_seconds) * 1000
        for s in self._list("data"):
            name = s.getPath().getName()
            if name in retired or name not in wanted and s.getModificationTime() < oldest:
                self._fs.delete(s.getPath(), True)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
