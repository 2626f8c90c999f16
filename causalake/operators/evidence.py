"""Counting the evidence behind targets, and leave-one-source-out robustness, for all graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from .paths import degrees, path_strength


def source_scores(nodes: DataFrame) -> DataFrame:
    """graph_id, key, source_scores: the largest node score by source of each name."""
    each = nodes.select("graph_id", match_key("name").alias("key"), F.explode(F.split("source", ", ")).alias("src"), "score").where("src <> ''")
    best = each.groupBy("graph_id", "key", "src").agg(F.max("score").alias("score"))
    return best.groupBy("graph_id", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "score")))).alias("source_scores"), F.count("*").alias("n_sources"), F.avg("score").alias("mean_source_score"))


def active_sources(nodes: DataFrame) -> DataFrame:
    """graph_id, n_active_sources among gene-like nodes."""
    each = nodes.where(F.col("node_type").isin("gene", "protein", "pathogen_gene")).select("graph_id", F.explode(F.split("source", ", ")).alias("src")).where("src <> ''")
    return each.groupBy("graph_id").agg(F.count_distinct("src").alias("n_active_sources"))


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge once for each end, as node_id; a self-loop counts twice."""
    return edges.select("*", F.explode(F.array("source_id", "target_id")).alias("node_id"))


def connections(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, n_pathways, n_interactions over in- and out-edges."""
    of = lambda t: F.count_if(F.col("edge_type") == t)
    return both_ends(edges).groupBy("graph_id", "node_id").agg(of("participates_in").alias("n_pathways"), of("interacts_with").alias("n_interactions"))


def corroboration(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, n_primary, corroboration: distinct primary sources, or an edge's own source where it names none."""
    named = F.when(F.size(F.coalesce("primary_sources", F.array().cast("array<string>"))) > 0, F.col("primary_sources")).otherwise(F.filter(F.array("source_db"), lambda s: F.coalesce(s, F.lit("")) != ""))
    each = both_ends(edges).select("graph_id", "node_id", F.explode_outer(named).alias("p"))
    n = each.groupBy("graph_id", "node_id").agg(F.count_distinct("p").alias("n_primary"))
    return n.withColumn("corroboration", F.least(F.lit(1.5), F.lit(1.0) + F.col("n_primary") * 0.1))


def evidence_streams(n_association="n_association", n_pathways="n_pathways", n_interactions="n_interactions", has_structure="has_structure", annotated="annotated", has_drug="has_drug"):
    """Of six independent streams, how many support a target."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return yes(F.col(n_association) > 0) + yes(F.col(n_pathways) > 0) + yes(F.col(n_interactions) > 0) + yes(F.col(has_structure)) + yes(F.col(annotated)) + yes(F.col(has_drug))


def evidence_score(targets: DataFrame) -> DataFrame:
    """targets with evidence_score, from score, path_strength, adjusted and, where there, betweenness, corroboration and causes."""
    has = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in targets.columns else F.lit(v)
    value = F.col("score") * F.col("path_strength") * F.when(F.col("adjusted"), 1.0).otherwise(0.8) * (1 + has("betweenness", 0.0)) * has("corroboration", 1.0)
    return targets.withColumn("evidence_score", value * F.when(has("causes", False), 1.5).otherwise(1.0))


def robustness(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """graph_id, treatment, outcome, source_stability, path_robustness, degree_robustness, robustness.

    pairs: graph_id, treatment, outcome, score. For every source that touches the treatment, all its edges in
    the graph are left out and the path strength is found again: one batch of searches keyed (treatment, source).
    """
    touching = both_ends(edges).where("coalesce(source_db, '') <> ''").select("graph_id", F.col("node_id").alias("treatment"), F.col("source_db").alias("excluded")).distinct()
    runs = pairs.join(touching, ["graph_id", "treatment"])
    several = F.count("*").over(Window.partitionBy("graph_id", "treatment", "outcome"))
    runs = runs.withColumn("_n", several).where("_n > 1").drop("_n")
    effects = path_strength(edges, runs, most).withColumn("effect", F.col("score") * F.col("path_strength"))
    spread = effects.groupBy("graph_id", "treatment", "outcome").agg(F.avg("effect").alias("m"), F.stddev_pop("effect").alias("s"))
    cv = F.when(F.col("m") != 0, F.col("s") / (F.abs("m") + 1e-8)).otherwise(1.0)
    spread = spread.select("graph_id", "treatment", "outcome", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cv)).alias("source_stability"))
    whole = path_strength(edges, pairs, most).withColumn("path_robustness", F.when(F.col("hops") > 0, F.least(F.lit(1.0), 1 / F.col("hops"))).when(F.col("uhops").isNotNull(), 0.3).otherwise(0.0))
    deg = degrees(edges).select("graph_id", F.col("node_id").alias("treatment"), F.least(F.lit(1.0), (F.col("in_degree") + F.col("out_degree")) / 10).alias("degree_robustness"))
    rows = whole.join(spread, ["graph_id", "treatment", "outcome"], "left").join(deg, ["graph_id", "treatment"], "left")
    rows = rows.withColumns({"source_stability": F.coalesce("source_stability", F.lit(0.3)), "degree_robustness": F.coalesce("degree_robustness", F.lit(0.0))})
    mean = (F.col("source_stability") + F.col("path_robustness") + F.col("degree_robustness")) / 3
    return rows.select("graph_id", "treatment", "outcome", "source_stability", "path_robustness", "degree_robustness", mean.alias("robustness"))
