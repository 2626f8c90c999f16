"""Observation buffers: each key's observations are counted, and every so many the line through all of them is fitted anew.

The state of a key is five sums, whatever it has seen, so a buffer of any length is recalibrated without being held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SUMS = ("n", "x", "y", "xx", "xy")


def _fitted(rows: DataFrame) -> DataFrame:
    """key, n, mean_x, mean_y, slope, intercept of sums; no slope where x doesn't vary."""
    spread = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / spread)
    held = rows.select("key", "n", (F.col("x") / F.col("n")).alias("mean_x"), (F.col("y") / F.col("n")).alias("mean_y"), slope.alias("slope"))
    return held.withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))


def _observed(rows: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Observations with both numbers, under neutral names."""
    held = rows.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return held.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def recalibrations(rows: DataFrame, key: str, order: str, x: str, y: str, every: int) -> DataFrame:
    """key, n, mean_x, mean_y, slope, intercept at each `every`-th observation of a key, over all of its observations so far.

    Observations are taken by `order`, which tells those of a key apart. Rows without both numbers aren't observations.
    """
    upto = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    held = _observed(rows, key, order, x, y).select("key", *(F.sum(v).over(upto).alias(n) for n, v in zip(SUMS, (F.lit(1), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y")), strict=True)))
    return _fitted(held.where(F.col("n") % every == 0))


def recalibrations_stream(rows: DataFrame, key: str, order: str, x: str, y: str, every: int) -> DataFrame:
    """The same rows from a stream, told as soon as a key's count gets there; later micro-batches bring later observations."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        part = pd.concat(list(parts)).sort_values("ord")
        sums = pd.DataFrame({"n": 1, "x": part["x"], "y": part["y"], "xx": part["x"] ** 2, "xy": part["x"] * part["y"]}).cumsum()
        for name, was in zip(SUMS, held, strict=True):
            sums[name] += was
        last = sums.iloc[-1]
        state.update((int(last["n"]), *(float(last[c]) for c in SUMS[1:])))
        told = sums[sums["n"] % every == 0]
        yield told.assign(key=k[0])[["key", *SUMS]]

    held = _observed(rows, key, order, x, y)
    kind = dict(held.dtypes)["key"]
    schema = "n long, x double, y double, xx double, xy double"
    return _fitted(held.groupBy("key").applyInPandasWithState(step, f"key {kind}, {schema}", schema, "append", GroupStateTimeout.NoTimeout))
