"""Whole queries: associations and interactions of a release to ranked, labelled targets of every disease at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import causal as C
from ..operators import components as CO
from ..operators import evidence as E
from ..operators import frames as A
from ..operators import graph as G
from ..operators import paths as PA
from ..operators import ranking as R
from ..runtime import cut


def disease_graphs(assoc: DataFrame, interactions: DataFrame, genes: int = 25) -> tuple[DataFrame, DataFrame]:
    """Nodes and resolved edges of every disease: its best genetic targets, their association and regulatory edges.

    Each input is read once: associations for the best score of each target and datatype, interactions (with ord, their order of
    arrival) for the first of each pair and sign. Graphs are made of these.
    """
    nodes, toward = A.snapshot_graph(cut(A.best_scores(assoc), "best-scores"), genes)
    disease = nodes.groupBy("graph_id").agg(F.first(F.concat(F.lit("disease:"), F.regexp_replace(F.lower("graph_id"), " ", "_"))).alias("node_id"))
    disease = disease.select("graph_id", "node_id", F.col("graph_id").alias("name"), F.lit("disease").alias("node_type"), F.lit("").alias("source"), F.lit(1.0).alias("score"))
    nodes = cut(nodes.unionByName(disease, allowMissingColumns=True).drop("datatype_scores"), "graph-nodes")
    known = nodes.where("node_type = 'gene'").select("graph_id", F.col("name").alias("symbol"))
    regulatory = G.interaction_edges(G.first_interactions(interactions, known), known)
    regulatory = regulatory.withColumn("ord", F.concat_ws("|", F.lit("1"), "source_id", "target_id", "edge_type"))
    none = F.array().cast("array<string>")
    toward = toward.withColumn("ord", F.concat_ws("|", F.lit("0"), "source_id")).withColumn("sign", F.lit(0)).withColumn("primary_sources", none).withColumn("pmids", none)
    edges = G.resolve_collisions(G.dedup_edges(toward.unionByName(regulatory)))
    return nodes, cut(edges, "graph-edges")


#: What holds for a target of which facts say nothing.
UNKNOWN = {"has_structure": False, "has_accession": False, "tractable": False, "is_druggable": False, "description": "", "target_type": "host_invasion", "tissue_relevant": True}


def ranked_targets(nodes: DataFrame, edges: DataFrame, n: int = 10, hops: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """The n reported targets of each graph with verdict, evidence score, robustness, confidence and label.

    facts: (graph_id, name) and columns of UNKNOWN: druggability, target class and tissue of each target.
    """
    disease = nodes.where("node_type = 'disease'").select("graph_id", F.col("node_id").alias("outcome"))
    pairs = nodes.where("node_type = 'gene'").join(disease, "graph_id").select("graph_id", F.col("node_id").alias("treatment"), "outcome", "score", "n_associated_diseases", "name", "source")
    keys = ["graph_id", "treatment", "outcome"]
    # The whole search: sets of any size, of all nodes that a treatment doesn't reach.
    verdict = C.identification(edges, nodes, pairs, most=None, pool=None)
    strength = PA.path_strength(edges, pairs.select(*keys), hops).select(*keys, "path_strength")
    robust = E.robustness(edges, pairs.select(*keys, "score"), hops).select(*keys, "robustness")
    between = CO.betweenness(edges).withColumnRenamed("node_id", "treatment")
    corroborated = E.corroboration(edges).withColumnRenamed("node_id", "treatment")
    links = E.connections(edges).withColumnRenamed("node_id", "treatment")
    rows = pairs.join(verdict, keys).join(strength, keys).join(robust, keys)
    for side in (between, corroborated, links):
        rows = rows.join(side, ["graph_id", "treatment"], "left")
    rows = E.evidence_score(rows.withColumn("adjusted", F.size("adjustment_set") > 0))
    rows = rows.join(E.active_sources(nodes), "graph_id", "left")
    n_src = F.size(F.split("source", ", "))
    if facts is not None:
        rows = rows.join(facts, ["graph_id", "name"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v) for c, v in UNKNOWN.items()})
    drug = S.druggability("has_structure", "has_accession", "tractable", "is_druggable", "description")
    rows = rows.withColumn("evidence_streams", F.lit(1) + (F.coalesce("n_interactions", F.lit(0)) > 0).cast("int"))
    rows = rows.withColumn("causal_confidence", S.causal_confidence("evidence_score", "robustness", "identifiable", S.consensus(n_src, "n_active_sources", "score"), S.specificity("n_associated_diseases"), drug))
    label = S.classification("causal_confidence", "robustness", "identifiable", "evidence_streams", "target_type", "tissue_relevant")
    rows = rows.withColumns({"label": label, "ord": F.col("treatment")})
    return R.quota_ranking(rows, n).select("graph_id", "rank", "name", "causal_confidence", "label", "reason", "adjustment_set", F.round("evidence_score", 6).alias("evidence_score"), F.round("robustness", 6).alias("robustness"))
