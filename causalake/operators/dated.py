"""Graphs as of a date: what sources without a pinned release would have brought, and who contributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..schemas import GENE_LIKE
from ..sources.snapshots import SnapshotStore
from .frames import snapshot_graph
from .graph import interaction_edges

#: Sources that are read from a pinned release, as lists of sources and as nodes and edges name them.
PINNED = ("OpenTargets", "Open Targets", "OmniPath")


def dated_graph(nodes: DataFrame, edges: DataFrame, frame: DataFrame, pinned: tuple[str, ...] = PINNED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of pinned sources, and what all others would have brought: graph_id, source, reason, item, n_nodes, n_edges.

    A source without a pinned release brings nothing to a dated graph, not even inside the frame: its name alone would count as a
    stream of evidence. Its pathogen genes are told as excluded_by_type (item: node id), its gene-like nodes off the frame as
    off_frame (item: name), each once; the nodes that remain, and edges of it that touch no node told, are counted as withheld.
    nodes: graph_id, source, node_id, name, node_type; edges: graph_id, source_db, source_id, target_id. A null source isn't pinned.
    """
    of = lambda c: F.coalesce(F.col(c).isin(*pinned), F.lit(False))
    known = frame.select("graph_id", match_key("node_id").alias("_k"), F.lit(True).alias("_in")).distinct()
    other = nodes.where(~of("source")).withColumn("_k", match_key("node_id")).join(known, ["graph_id", "_k"], "left")
    gene = F.col("node_type").isin(*GENE_LIKE) & F.col("_in").isNull()
    other = other.withColumn("reason", F.when(F.col("node_type") == "pathogen_gene", "excluded_by_type").when(gene, "off_frame"))
    gone = other.where("reason is not null")
    item = F.when(F.col("reason") == "off_frame", F.col("name")).otherwise(F.col("node_id"))
    none = F.lit(None).cast("bigint")
    told = gone.select("graph_id", "source", "reason", item.alias("item")).distinct().withColumns({"n_nodes": none, "n_edges": none})
    # Both counts by one grouping; null sources meet, as they do in no join.
    held = other.where("reason is null").select("graph_id", "source", F.lit(1).alias("a"), F.lit(0).alias("b"))
    left = edges.where(~of("source_db")).select("graph_id", F.col("source_db").alias("source"), "source_id", "target_id")
    ids = gone.select("graph_id", "source", "node_id").distinct()
    for end in ("source_id", "target_id"):
        same = (left["graph_id"] == ids["graph_id"]) & left["source"].eqNullSafe(ids["source"]) & (left[end] == ids["node_id"])
        left = left.join(ids, same, "left_anti")
    held = held.union(left.select("graph_id", "source", F.lit(0), F.lit(1))).groupBy("graph_id", "source").agg(F.sum("a").alias("n_nodes"), F.sum("b").alias("n_edges"))
    kept = held.select("graph_id", "source", F.lit("withheld").alias("reason"), F.lit(None).cast("string").alias("item"), "n_nodes", "n_edges")
    return nodes.where(of("source")), edges.where(of("source_db")), told.union(kept)


def contributors(queried: DataFrame, dated: bool, pinned: tuple[str, ...] = PINNED) -> DataFrame:
    """queried (graph_id, source, ...) as it is persisted: of a dated graph only sources that can have contributed."""
    return queried.where(F.col("source").isin(*pinned)) if dated else queried


#: What turns a source's table into nodes and edges.
READERS: dict[str, Callable] = {"opentargets": snapshot_graph, "omnipath": interaction_edges}


def snapshot_reader(source: str, store: SnapshotStore, release: str) -> Callable:
    """The source's reader, bound to the table of a release; other arguments are the reader's. A source without a reader is an error."""
    if source not in READERS:
        raise KeyError(f"{source} has no snapshot reader; known: {sorted(READERS)}")
    return lambda *args, **more: READERS[source](store.read(source, release), *args, **more)
