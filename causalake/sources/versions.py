"""Versioned tables: a commit is one small pointer file, so a reader sees the old version or the new one, never neither.

    <path>/data/<folder>/       a version's Parquet files, written once
    <path>/log/<number>         a pointer: the folder's name and a line end

A pointer is created only where none stands, so of two writers of one number one fails and nothing is lost. A writer that dies
before its pointer is whole leaves a folder that no pointer names; prune() sweeps those and old versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import upserted


class Conflict(RuntimeError):
    """Another writer committed this version first; take its result and try again."""


class VersionedTable:
    """A table at a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, rest: str):
        return self._hadoop.Path(f"{self.path}/{rest}" if rest else self.path)

    def _names(self, rest: str) -> list[str]:
        place = self._at(rest)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def versions(self) -> dict[int, str]:
        """Folder of each whole version by number. A table has some pointers; they are read on the driver."""
        out = {}
        for name in self._names("log"):
            if name.isdigit():
                stream = self._fs.open(self._at(f"log/{name}"))
                try:
                    said = bytes(stream.readNBytes(1_000)).decode()
                finally:
                    stream.close()
                if said.endswith("\n"):
                    out[int(name)] = said.strip()
        return out

    def latest(self) -> int:
        """The newest version's number; 0 for none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a given one."""
        held = self.versions()
        version = max(held, default=0) if version is None else version
        if version not in held:
            raise FileNotFoundError(f"no version {version} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/data/{held[version]}")

    def write(self, rows: DataFrame, base: int | None = None) -> int:
        """rows as the next version, whose number is returned; base: the version that rows were made from, else the newest."""
        last = max((int(x) for x in self._names("log") if x.isdigit()), default=0)
        if base is not None and self.latest() != base:
            raise Conflict(f"version {self.latest()} of {self.path} came after {base}")
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        self._commit(last + 1, folder)
        return last + 1

    def _commit(self, number: int, folder: str) -> None:
        try:
            stream = self._fs.create(self._at(f"log/{number:012d}"), False)
        except Exception as e:
            if "AlreadyExists" in type(e).__name__ + str(e):
                raise Conflict(f"version {number} of {self.path} is taken") from e
            raise
        try:
            stream.write(bytearray(f"{folder}\n".encode()))
        finally:
            stream.close()

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str]) -> int:
        """The latest row of each key, old and new, as the next version."""
        base = self.latest()
        old = self.read(base) if base else rows.limit(0)
        return self.write(upserted(old, rows, keys, order), base)

    def files(self) -> DataFrame:
        """folder, bytes of everything under data."""
        sizes = [(x, self._fs.getContentSummary(self._at(f"data/{x}")).getLength()) for x in self._names("data")]
        return self.spark.createDataFrame(sizes, "folder string, bytes long")

    def prune(self, keep: int = 1) -> int:
        """Drops all but the newest `keep` versions, and folders that no pointer names; gives the bytes freed.

        Mark and sweep: pointers go first, so no version is named whose files are gone. Not to be run beside a writer, whose
        folder has no pointer yet.
        """
        held = self.versions()
        marked = sorted(held)[-keep:] if keep else []
        for n in held:
            if n not in marked:
                self._fs.delete(self._at(f"log/{n:012d}"), False)
        named = self.spark.createDataFrame([(held[n],) for n in marked], "folder string")
        swept = self.files().join(named, "folder", "left_anti").collect()  # a row for each version
        for r in swept:
            self._fs.delete(self._at(f"data/{r.folder}"), True)
        return sum(r.bytes for r in swept)


def prune_inputs(records: DataFrame, inputs: DataFrame, keep: DataFrame) -> DataFrame:
    """run, replayable, pruned_bytes, input: what a prune of runs' frozen inputs drops, and each record after it.

    records: run; inputs: run, input, bytes (inputs may be shared); keep: run, those that stay replayable. An input goes if no kept run uses it.
    """
    used = inputs.join(keep.select("run").distinct(), "run", "left_semi").select("input").distinct()
    gone = inputs.join(used, "input", "left_anti")
    # A shared input's bytes are freed once: by its first run.
    freed = gone.groupBy("input").agg(F.min("run").alias("run"), F.max("bytes").alias("bytes")).groupBy("run").agg(F.sum("bytes").alias("pruned_bytes"))
    held = records.join(gone.groupBy("run").agg(F.array_sort(F.collect_set("input")).alias("dropped")), "run", "left").join(freed, "run", "left")
    return held.select("run", F.col("dropped").isNull().alias("replayable"), F.coalesce("pruned_bytes", F.lit(0)).alias("pruned_bytes"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"))
