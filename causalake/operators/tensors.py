"""Graphs as index arrays: edge lists by node place and type number, and compressed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "associated_with"


def edge_vocabulary(edges: DataFrame, most: int = 1_000) -> DataFrame:
    """edge_type, type_id: the kinds of edge by how common they are, then by name; 0 is kept for all others.

    At most `most` kinds: vocabularies are broadcast.
    """
    kinds = edges.select(_kind(edges).alias("edge_type")).where(F.col("edge_type") != UNKNOWN).groupBy("edge_type").agg(F.count("*").alias("_n"))
    top = kinds.orderBy(F.desc("_n"), "edge_type").limit(most)
    return top.select("edge_type", F.row_number().over(Window.orderBy(F.desc("_n"), "edge_type")).alias("type_id"))  # `most` rows


def _kind(edges: DataFrame):
    kind = F.lower(F.coalesce("edge_type", F.lit(UNKNOWN)))
    return F.when(F.col("evidence_type") == "learned", "learned").otherwise(kind) if "evidence_type" in edges.columns else kind


def node_places(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, place: nodes of each graph numbered from 0 in name order; a repeated node has one place."""
    one = nodes.select("graph_id", "node_id").distinct()
    return one.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1)


def edge_index(places: DataFrame, edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """graph_id, source_place, target_place, type_id of each edge whose ends both have a place; unknown kinds are 0. Repeated edges stay."""
    at = lambda end, name: places.select("graph_id", F.col("node_id").alias(end), F.col("place").alias(name))
    held = edges.withColumn("_kind", _kind(edges)).join(at("source_id", "source_place"), ["graph_id", "source_id"]).join(at("target_id", "target_place"), ["graph_id", "target_id"])
    known = vocabulary.select(F.col("edge_type").alias("_kind"), "type_id")
    return held.join(F.broadcast(known), "_kind", "left").select("graph_id", "source_place", "target_place", F.coalesce("type_id", F.lit(0)).alias("type_id"))


def compressed_rows(places: DataFrame, index: DataFrame) -> DataFrame:
    """graph_id, offsets, targets, types: each graph's adjacency as compressed rows, one row a graph.

    Edges of node i are targets[offsets[i] : offsets[i + 1]], by target, then type. A node's edges are gathered first and sorted
    there; a graph's arrays are one value, which graph assembly bounds.
    """
    each = index.groupBy("graph_id", F.col("source_place").alias("place")).agg(F.array_sort(F.collect_list(F.struct("target_place", "type_id"))).alias("_e"))
    rows = places.select("graph_id", "place").join(each, ["graph_id", "place"], "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<target_place:int,type_id:int>>")))
    lists = F.array_sort(F.collect_list(F.struct("place", "_e")))
    held = rows.groupBy("graph_id").agg(lists.alias("_l")).withColumn("_l", F.transform("_l", lambda x: x["_e"])).withColumn("_all", F.flatten("_l"))
    sizes = F.transform("_l", F.size)
    offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
    return held.select("graph_id", offsets.alias("offsets"), F.transform("_all", lambda x: x["target_place"]).alias("targets"), F.transform("_all", lambda x: x["type_id"]).alias("types"))


def from_compressed_rows(rows: DataFrame) -> DataFrame:
    """graph_id, source_place, target_place, type_id: back from compressed_rows()."""
    spans = rows.select("graph_id", "targets", "types", F.posexplode(F.slice("offsets", F.lit(1), F.size("offsets") - 1)).alias("source_place", "_a"), F.col("offsets").alias("_o"))
    spans = spans.withColumn("_n", F.get("_o", F.col("source_place") + 1) - F.col("_a"))
    edges = spans.select("graph_id", "source_place", F.explode(F.arrays_zip(F.slice("targets", F.col("_a") + 1, F.col("_n")).alias("t"), F.slice("types", F.col("_a") + 1, F.col("_n")).alias("k"))).alias("x"))
    return edges.select("graph_id", "source_place", F.col("x.t").alias("target_place"), F.col("x.k").alias("type_id"))
