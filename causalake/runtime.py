"""Cutting the lineage of iterative queries by written tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (local tests), a temporary folder."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = found.get() if found.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="causalake-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/causalake/{name}-{uuid.uuid4().hex}"


def counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """df as a written table, and its number of rows."""
    out = cut(df, name)
    return out, out.count()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table: later rounds read it and don't repeat what led to it, and it survives lost executors."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grown:
    """A written table that the rounds of a search append to, a folder for each round. `size` is the last round's rows.

    Rounds hold no literal of their own: equal plans are compiled once for all rounds.
    """

    def __init__(self, first: DataFrame, name: str = "grown") -> None:
        self.spark, self.schema = first.sparkSession, first.schema
        self.path, self.rounds, self.size = _path(self.spark, name), 0, 0
        self.added = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """df as it was written."""
        path = f"{self.path}/{self.rounds}"
        df.select(*self.schema.names).write.parquet(path)
        self.rounds += 1
        added = self.spark.read.schema(self.schema).parquet(path)
        self.size = added.count()
        return added

    def table(self) -> DataFrame:
        """All rounds so far."""
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{i}" for i in range(self.rounds)))
