"""Streams: append-only runs, resumable work, keyed state, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, a few for each micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def append_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended as JSON lines; what a crash leaves complete stays, and a restart goes on behind it."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_rows(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def resumable(rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Each micro-batch without the keys already written at path, worked and appended."""

    def batch(part: DataFrame, _: int) -> None:
        spark = part.sparkSession
        try:
            done = spark.read.parquet(path).select(key).distinct()
            part = part.join(done, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        work(part.dropDuplicates([key])).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(rows: DataFrame, time: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """n and total value in tumbling (or sliding) windows behind a watermark: an extension, the reference has no event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    held = rows.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return held.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    held = rows.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return held.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def arm_updates(rows: DataFrame, arm: str = "event_type", value: str = "value") -> DataFrame:
    """n and total reward of each arm, updated as rows arrive: the state of an upper-confidence-bound choice."""
    return rows.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def ring_buffer(rows: DataFrame, key: str, order: str, value: str, capacity: int) -> DataFrame:
    """key, n_seen, kept: how many values a bounded buffer of each key has seen and its newest ones, by custom state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, parts, state: GroupState):
        seen, kept = state.get if state.exists else (0, [])
        for part in parts:
            seen += len(part)
            kept = [*kept, *part.sort_values(order)[value].astype(float).tolist()][-capacity:]
        state.update((seen, kept))
        yield pd.DataFrame({"key": [k[0]], "n_seen": [seen], "kept": [kept]})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"key {kind}, n_seen long, kept array<double>", "seen long, kept array<double>", "update", GroupStateTimeout.NoTimeout)
