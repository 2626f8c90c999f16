"""Versioned snapshot store: canonical extracts by source and release, with a manifest and digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import digest, upserted

# Fixed value: part of an extract's identity.
EXTRACTOR_VERSION = 2


class MissingSnapshot(FileNotFoundError):
    """A release that was never built: an error, where an empty one would be a finding."""


class SnapshotStore:
    """Reads of <root>/<source>/release=<release>; each read is reported to a hook for provenance."""

    def __init__(self, spark: SparkSession, root: str, on_read: Callable[[str, str, str], None] | None = None) -> None:
        self.spark, self.root, self.on_read = spark, root.rstrip("/"), on_read

    def path(self, source: str, release: str) -> str:
        return f"{self.root}/{source}/release={release}"

    def has(self, source: str, release: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(source, release))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, source: str, release: str) -> DataFrame:
        if not self.has(source, release):
            raise MissingSnapshot(f"no snapshot of {source} {release} under {self.root}; build it first")
        if self.on_read:
            self.on_read(source, release, self.path(source, release))
        return self.spark.read.parquet(self.path(source, release))

    def associations(self, release: str) -> DataFrame:
        return self.read("opentargets", release)

    def interactions(self, release: str) -> DataFrame:
        return self.read("omnipath", release)

    def write(self, source: str, release: str, rows: DataFrame, cluster: str | None = None) -> DataFrame:
        """Write an extract, clustered for pruning, and put its digest into the manifest; returns the entry."""
        if cluster:
            rows = rows.repartitionByRange(cluster).sortWithinPartitions(cluster)
        rows.write.mode("overwrite").parquet(self.path(source, release))
        entry = digest(self.spark.read.parquet(self.path(source, release))).select(F.lit(source).alias("source"), F.lit(release).alias("release"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"), "n", "digest", F.current_timestamp().alias("built_at"))
        old, place = self.manifest(), f"{self.root}/_manifest"
        # The old entries are read whole before the folder is replaced; a manifest has one row for each release.
        held = [r.asDict() for r in (entry if old is None else upserted(old, entry, ["source", "release"], ["built_at"])).collect()]
        self.spark.createDataFrame(held, entry.schema).coalesce(1).write.mode("overwrite").parquet(place)
        return entry

    def manifest(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(f"{self.root}/_manifest") if found else None


class SourceResolver:
    """Which table answers for a source: live where no date is asked, a pinned snapshot or refusal where one is."""

    def __init__(self, store: SnapshotStore, release_for: Callable[[str, str], str], pinned: tuple[str, ...] = ("opentargets", "omnipath")) -> None:
        self.store, self.release_for, self.pinned = store, release_for, pinned

    def resolve(self, source: str, as_of: str | None) -> tuple[str, str | None]:
        if as_of is None or source not in self.pinned:
            return "live", None
        release = self.release_for(source, as_of)
        if not self.store.has(source, release):
            raise MissingSnapshot(f"{source} {release} is pinned at {as_of} but not built")
        return "snapshot", release


def settled(reads: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, release, finding of reads (source, release, digest): uncited, mismatched, or null where they agree."""
    m = manifest.select("source", "release", F.col("digest").alias("_known"))
    rows = reads.join(m, ["source", "release"], "left")
    return rows.select("source", "release", F.when(F.col("_known").isNull(), "uncited").when(F.col("_known") != F.col("digest"), "mismatched").alias("finding"))
