"""Sinks: graphs as JSON or XML, keyed upserts, run rows, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import VersionedTable


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, document: each graph as one JSON text of nodes and edges. A graph is bounded by its assembly's caps."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in nodes.columns if c != "graph_id"])))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in edges.columns if c != "graph_id"])))).alias("edges"))
    rows = n.join(e, "graph_id", "full")
    text = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    return rows.select("graph_id", F.concat(F.lit('{"nodes":'), text("nodes"), F.lit(',"edges":'), text("edges"), F.lit("}")).alias("document"))


def graph_rows(documents: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges back from documents."""
    j = documents.select("graph_id", F.from_json("document", f"struct<nodes:array<{node_schema}>,edges:array<{edge_schema}>>").alias("j"))
    return j.select("graph_id", F.inline("j.nodes")), j.select("graph_id", F.inline("j.edges"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, document: GraphML text."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    n = nodes.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<node id="'), esc("node_id"), F.lit('"/>')))), "").alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<edge source="'), esc("source_id"), F.lit('" target="'), esc("target_id"), F.lit('"/>')))), "").alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.concat(F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>")).alias("document"))


def upsert(path: str, rows: DataFrame, keys: list[str], order: list[str]) -> int:
    """The latest row of each key as the next version of the table at path; read it by VersionedTable."""
    return VersionedTable(rows.sparkSession, path).upsert(rows, keys, order)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def top_summary(results: DataFrame, n: int = 20) -> DataFrame:
    """The n best docking results: a sort and limit, which keeps n rows of each task."""
    return results.orderBy("affinity", "ligand_name").limit(n)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
