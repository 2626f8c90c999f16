"""Sets of nodes as bits: a graph's nodes have places, and a row holds which of a block of 64 places are in a set.

A node's neighbours are a row for each block that holds one. On a dense graph a round of a search joins a row for 64 neighbours and
unites them by bit_or; on a sparse one it joins as many rows as there are edges, at most. Blocks of all starts are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Grown, cut

WIDTH = 64
SET = ["graph_id", "start", "block"]


def places(nodes: DataFrame) -> DataFrame:
    """graph_id, node, place: nodes of each graph numbered from 0 in name order."""
    return nodes.select("graph_id", "node").distinct().withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1)


def numbered(edges: DataFrame, at: DataFrame) -> DataFrame:
    """graph_id, a, b: places of the ends of edges (graph_id, source_id, target_id); repeated edges once."""
    end = lambda name, p: at.select("graph_id", F.col("node").alias(name), F.col("place").alias(p))
    return edges.select("graph_id", "source_id", "target_id").join(end("source_id", "a"), ["graph_id", "source_id"]).join(end("target_id", "b"), ["graph_id", "target_id"]).select("graph_id", "a", "b").distinct()


def united(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys, block, bits: the places of each group as blocks."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) % WIDTH)
    return rows.groupBy(*keys, F.floor(F.col(place) / WIDTH).cast("int").alias("block")).agg(F.bit_or(bit).alias("bits"))


def listed(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, place: a row for each bit of `bits`."""
    each = rows.select(*keep, "block", "bits", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("_i"))
    return each.where(F.getbit("bits", F.col("_i")) == 1).select(*keep, (F.col("block") * WIDTH + F.col("_i")).alias("place"))


def without(bits: str, had: str) -> Column:
    return F.col(bits).bitwiseAND(F.bitwise_not(F.coalesce(had, F.lit(0).cast("long"))))


def spread(rows: DataFrame) -> DataFrame:
    """rows by start over all cores: a few blocks lead to many rows."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "graph_id", "start")


def reached(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """graph_id, start, node, hops: each node that each start (graph_id, start) reaches, within `most` hops where given; itself at 0.

    Each (start, node) is once in a frontier and joins the blocks of its neighbours: rounds in all cost reached nodes times blocks.
    """
    edges = cut(edges.select("graph_id", "source_id", "target_id"), "reach-edges")
    ends = edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node")).unionByName(starts.select("graph_id", F.col("start").alias("node")))
    at = cut(places(ends), "places")
    near = cut(united(numbered(edges, at), ["graph_id", "a"], "b"), "neighbours")
    first = starts.distinct().join(at.withColumnRenamed("node", "start"), ["graph_id", "start"]).select("graph_id", F.col("place").alias("start"), "place")
    seen = Grown(united(first, ["graph_id", "start"], "place").withColumn("hops", F.lit(0)), "reached")
    frontier, hop = seen.added, 0
    while seen.size and (most is None or hop < most):
        hop += 1
        met = listed(spread(frontier), "graph_id", "start", "hops").withColumnRenamed("place", "a").join(near, ["graph_id", "a"])
        met = met.groupBy(*SET).agg(F.bit_or("bits").alias("bits"), (F.max("hops") + 1).alias("hops"))
        had = seen.table().groupBy(*SET).agg(F.bit_or("bits").alias("_had"))
        new = met.join(had, SET, "left").withColumn("bits", without("bits", "_had")).where("bits <> 0")
        frontier = seen.add(new.select(*SET, "bits", "hops"))
    every = listed(spread(seen.table()), "graph_id", "start", "hops")
    name = lambda p, n: at.select("graph_id", F.col("place").alias(p), F.col("node").alias(n))
    return every.join(name("place", "node"), ["graph_id", "place"]).join(name("start", "_start"), ["graph_id", "start"]).select("graph_id", F.col("_start").alias("start"), "node", "hops")
