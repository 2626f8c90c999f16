"""Run records and keyed tables: diffs, upserts, expiry, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str], ignore: tuple = ()) -> DataFrame:
    """key, field, before, after wherever two runs differ; a missing row or field is null."""
    fields = [f for f in fields if f not in ignore]

    def stacked(d: DataFrame, name: str) -> DataFrame:
        return d.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([key], fields, "field", name)

    held = stacked(a, "before").join(stacked(b, "after"), [key, "field"], "full")
    return held.where(~F.col("before").eqNullSafe(F.col("after")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows, the latest for each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unexpired(cache: DataFrame, now) -> DataFrame:
    return cache.where(F.col("expires_at") >= now)


def digest(rows: DataFrame) -> DataFrame:
    """One row: n and a digest of all rows that doesn't depend on order or files.

    Row hashes are summed in two independent 64-bit lanes, so the digest is one partial aggregate.
    """
    cols = sorted(rows.columns)
    j = F.to_json(F.struct(*cols))
    lane = lambda s: F.sum(F.xxhash64(j, F.lit(s)).cast("decimal(38,0)"))
    held = rows.agg(F.count("*").alias("n"), lane(1).alias("a"), lane(2).alias("b"))
    return held.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def pending(ligands: DataFrame, completed: DataFrame, key: str = "ligand_name") -> DataFrame:
    """Work that no completed row names."""
    return ligands.join(completed.select(key).distinct(), key, "left_anti")


def grid_statistics(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation of each value over the runs of each cell."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 6).alias(f"{v}_mean") for v in values), *(F.round(F.stddev_pop(v), 6).alias(f"{v}_std") for v in values))


def lookup_graph(graphs: DataFrame, name: str, as_of: str | None) -> DataFrame:
    """The newest stored graph of a name (any case) with exactly that date, null included."""
    w = Window.partitionBy(F.lower("disease_name")).orderBy(F.desc("created_at"))
    rows = graphs.where((F.lower("disease_name") == name.lower()) & F.col("as_of").eqNullSafe(F.lit(as_of)))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
